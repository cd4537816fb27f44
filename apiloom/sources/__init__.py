"""Reading source files, extracting facts, storing facts and graphs."""
