"""Web-service projects written from order tables: a corpus whose facts are known from the rows themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DEPS = '''from typing import Annotated
from fastapi import Depends, Header

def get_db():
    yield 1

def get_user(db=Depends(get_db)):
    return db

def require_admin(user=Depends(get_user)):
    return user

def verify_access(value):
    return value

Admin = Annotated[int, Depends(require_admin)]
'''
_MODELS = '''from sqlalchemy.orm import DeclarativeBase, Mapped, mapped_column, relationship
from sqlalchemy import ForeignKey

class Base(DeclarativeBase):
    pass

class Customer(Base):
    __tablename__ = "customer"
    id: Mapped[int] = mapped_column(primary_key=True)
    name: Mapped[str]
    orders = relationship("Order")

class Order(Base):
    __tablename__ = "orders"
    id: Mapped[int] = mapped_column(primary_key=True)
    customer_id: Mapped[int] = mapped_column(ForeignKey("customer.id"))
    total: Mapped[float]

class Archive(Base):
    __tablename__ = "archive"
    id: Mapped[int] = mapped_column(primary_key=True)
'''
_SCHEMAS = '''from pydantic import BaseModel, field_validator

class OrderBase(BaseModel):
    total: float

class OrderCreate(OrderBase):
    customer_id: int
    note: str = ""

    @field_validator("note")
    def check_note(cls, v):
        return v

class OrderPublic(OrderBase):
    id: int

class OrderList(BaseModel):
    items: list[OrderPublic]

class Unused(BaseModel):
    value: int
'''


def handler_source(key: Column, status: Column, priority: Column) -> Column:
    """One route handler for an order."""
    digit = F.substring(priority, 1, 1)
    method = F.when(status == "F", "get").when(status == "O", "delete").otherwise("post")
    guard = F.when(digit == "1", ", dependencies=[Depends(require_admin)]").otherwise("")
    model = F.when(key % 2 == 0, ", response_model=OrderPublic").otherwise("")
    param = F.when(digit == "2", "admin: Admin").when(digit == "3", "api_key: str = Header()").when(status == "P", "body: OrderCreate").otherwise("")
    check = F.when(digit == "4", "    verify_access(1)\n").otherwise("")
    sql = F.element_at(F.array(F.lit("SELECT * FROM customer"), F.lit("INSERT INTO orders(id) VALUES (1)"), F.lit("DELETE FROM orders WHERE id = 1"), F.lit("SELECT id FROM part JOIN orders ON true WHERE 1=1")), (key % 4 + 1).cast("int"))
    return F.concat(F.lit("@router."), method, F.lit('("/o'), (key % 40).cast("string"), F.lit('"'), guard, model, F.lit(")\ndef h"), key.cast("string"), F.lit("("), param, F.lit("):\n"), check, F.lit('    return run("'), sql, F.lit('")\n'))


def order_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files (project_id, path, mtime_ns, size, content): a project for each nation, a file for each customer with orders.

    Each customer's router has a handler for each order; routers of customers whose key ends in 9 are never included.
    """
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("project_id"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", handler_source(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("code"))
    bodies = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "code"))), lambda x: x["code"]), "\n").alias("body"))
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    head = F.concat(F.lit("from fastapi import APIRouter, Depends, Header\nfrom app.deps import Admin, require_admin, verify_access\nfrom app.schemas import OrderCreate, OrderPublic\n\nrouter = APIRouter(prefix=\"/"), name, F.lit('")\n\n'))
    served = customers.join(bodies, customers.c_custkey == bodies.o_custkey)
    routers = served.select("project_id", F.concat(F.lit("app/routes/"), name, F.lit(".py")).alias("path"), F.concat(head, "body").alias("content"))
    included = served.where("c_custkey % 10 <> 9").groupBy("project_id").agg(F.array_sort(F.collect_list("c_custkey")).alias("keys"))
    listed = lambda form: F.array_join(F.transform("keys", lambda k: F.format_string(form, k.cast("string"))), "\n")
    projects = customers.select("project_id").distinct().join(included, "project_id", "left")
    main = F.concat(F.lit("from fastapi import FastAPI\n"), F.coalesce(listed("from app.routes.c%1$s import router as r%1$s"), F.lit("")), F.lit("\napp = FastAPI()\n"), F.coalesce(listed('app.include_router(r%1$s, prefix="/api")'), F.lit("")), F.lit("\n"))
    fixed = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in (("app/__init__.py", ""), ("app/routes/__init__.py", ""), ("app/deps.py", _DEPS), ("app/models.py", _MODELS), ("app/schemas.py", _SCHEMAS), ("app/broken.py", "def oops(:\n"))])
    shared = projects.select("project_id", F.explode(F.concat(fixed, F.array(F.struct(F.lit("app/main.py").alias("path"), main.alias("content"))))).alias("f")).select("project_id", "f.path", "f.content")
    files = routers.unionByName(shared)
    return files.select("project_id", "path", F.lit(0).cast("long").alias("mtime_ns"), F.octet_length("content").cast("long").alias("size"), F.col("content").cast("binary").alias("content"))


_YARD = {
    "yard/__init__.py": "from yard.core import check_badge\n",
    "yard/core.py": "from yard.deep import check_badge\n",
    "yard/deep.py": "def check_badge(): ...\n",
}


def supplier_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files of a project for each nation, a file for each supplier, with the deeper shapes that services have.

    Routers within routers, a dependency that three modules hand on, middleware, templates, several methods and a
    websocket on one router, a circle of dependencies, a function defined twice, a type alias, tables without a base of
    their own and an abstract model.
    """
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.concat(F.lit("site_"), F.col("s_nationkey").cast("string")).alias("project_id"))
    text = '''from typing import Annotated
from fastapi import APIRouter, Depends, FastAPI
from sqlalchemy.orm import declarative_base
from sqlmodel import SQLModel
from yard import check_badge

Stem = declarative_base()
gate = FastAPI()
outer = APIRouter(prefix="/o%1$s")
inner = APIRouter(prefix="/i", dependencies=[Depends(check_badge)])
outer.include_router(inner, prefix="/n")
gate.include_router(outer, prefix="/v%2$s")
gate.add_middleware(Squeeze)
type Ref%1$s = Annotated[int, Depends(check_badge)]

class Bin%1$s(SQLModel, table=True):
    load: int

class Shape%1$s(Stem):
    __abstract__ = True

class Rack%1$s(Stem):
    __tablename__ = "rack_%1$s"

@gate.middleware("http")
async def stamp%1$s(request, call_next): ...

@inner.api_route("/w", methods=["GET", "PUT"])
def weigh%1$s():
    return pages.TemplateResponse("t%3$s.html", {"</script>": 1})

@inner.websocket("/h")
async def horn%1$s(ws, ref: Ref%1$s): ...

def tick%1$s(a=Depends(tock%1$s)): ...

def tock%1$s(a=Depends(tick%1$s)): ...

def again%1$s(): ...

async def again%1$s(): ...
'''
    key = F.col("s_suppkey").cast("string")
    files = suppliers.select("project_id", F.concat(F.lit("yard/s"), key, F.lit(".py")).alias("path"), F.format_string(text, key, F.substring("project_id", 6, 9), (F.col("s_suppkey") % 7).cast("string")).alias("content"))
    fixed = F.array(*[F.struct(F.lit(path).alias("path"), F.lit(content).alias("content")) for path, content in _YARD.items()])
    shared = suppliers.select("project_id").distinct().select("project_id", F.explode(fixed).alias("f")).select("project_id", "f.path", "f.content")
    both = files.unionByName(shared)
    return both.select("project_id", "path", F.lit(0).cast("long").alias("mtime_ns"), F.octet_length("content").cast("long").alias("size"), F.col("content").cast("binary").alias("content"))


def part_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files of a project for each brand, a file for each part: its ORM models and schemas, told by the part's row."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", F.concat(F.lit("brand_"), F.regexp_extract("p_brand", r"(\d+)$", 1)).alias("project_id"))
    text = '''from pydantic import BaseModel
from sqlalchemy import ForeignKey
from sqlalchemy.orm import DeclarativeBase, Mapped, mapped_column, relationship

class Root%1$s(DeclarativeBase):
    pass

class Item%1$s(Root%1$s):
    __tablename__ = "item_%1$s"
    id: Mapped[int] = mapped_column(primary_key=True)
    size_%2$s: Mapped[int]
    bin_id: Mapped[int] = mapped_column(ForeignKey("bin_%2$s.id"))
    peers = relationship("Peer%1$s")

class Peer%1$s(Root%1$s):
    __tablename__ = "peer_%3$s"
    id: Mapped[int] = mapped_column(primary_key=True)

class Item%1$sCreate(BaseModel):
    size_%2$s: int
    note: str = "%3$s"

class Item%1$sUpdate(Item%1$sCreate):
    extra: str

class Page%1$s(BaseModel):
    rows: list[Item%1$sUpdate]

def stray%1$s(x=Depends(outside%3$s)): ...
'''
    key = F.col("p_partkey").cast("string")
    files = parts.select("project_id", F.concat(F.lit("stock/p"), key, F.lit(".py")).alias("path"), F.format_string(text, key, F.col("p_size").cast("string"), (F.col("p_partkey") % 9).cast("string")).alias("content"))
    return files.select("project_id", "path", F.lit(0).cast("long").alias("mtime_ns"), F.octet_length("content").cast("long").alias("size"), F.col("content").cast("binary").alias("content"))
