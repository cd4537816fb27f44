"""Questions over node and edge tables."""
