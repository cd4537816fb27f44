"""Facts of Python source files: one row for each thing a file says, names as written.

The only code that runs in Python: a walk over the standard library's syntax tree, inside ``mapInArrow``. Everything
that needs another file (resolution, types, paths) is left to joins over these rows.
"""

from __future__ import annotations

import ast
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiloom.functions.names import module_name
from apiloom.schemas import FACTS

# Names with a meaning in web-service code.
ROUTE_METHODS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")
DEPENDENCY_CALLS = ("Depends", "Security")
PARAM_SOURCES = ("Header", "Query", "Body", "Path", "Cookie", "Form", "File")
TEMPLATE_CALLS = ("TemplateResponse", "get_template")
TEMPLATE_ENDINGS = (".html", ".htm", ".jinja", ".jinja2", ".j2", ".xml", ".txt")
BASE_FACTORIES = ("declarative_base", "generate_base")
COLUMN_CALLS = ("Column", "mapped_column", "Field")
#: A dependency without a target: what it depends on is the parameter's own type.
OWN_TYPE = "@annotation"

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (*_FUNCTIONS, ast.ClassDef)
_IMPORTS = (ast.Import, ast.ImportFrom)
#: Nodes that say something wherever they stand; all others are passed over by their class alone.
_SAYING = frozenset((*_SCOPES, *_IMPORTS, ast.Call, ast.AnnAssign))
#: Characters of a file that are parsed at once; a longer file is parsed piece by piece.
PIECE = 1 << 18
#: Where a statement of the module may begin: a line that is neither indented nor goes on with the statement before.
_BEGIN = re.compile(r"\n(?=[A-Za-z_@])(?!(?:else|elif|except|finally)\b)")
#: Facts that leave a Python worker at once.
BATCH_FACTS = 50_000
_fields: dict[type, tuple[str, ...]] = {}


def holds_nodes(kind: object) -> bool:
    """A field of this type can hold nodes: not one of names, numbers and the like alone."""
    inner = getattr(kind, "__args__", None) or (kind,)
    return not all(x in (str, int, type(None)) for x in inner)


def levels(node: ast.AST) -> Iterator[list[ast.AST]]:
    """Nodes by their depth, each level in the order of ``ast.walk``, without contexts and operators, which say nothing."""
    level = [node]
    while level:
        yield level
        below: list[ast.AST] = []
        for n in level:
            cls = n.__class__
            fields = _fields.get(cls)
            if fields is None:
                fields = _fields[cls] = () if cls in (ast.Name, ast.Constant) else tuple(f for f in cls._fields if f not in ("ctx", "op", "ops") and holds_nodes(cls._field_types.get(f)))
            for f in fields:
                value = getattr(n, f, None)
                if not value:
                    continue
                if value.__class__ is list:
                    below += [x for x in value if isinstance(x, ast.AST)]
                elif isinstance(value, ast.AST):
                    below.append(value)
        level = below


def walk(node: ast.AST) -> list[ast.AST]:
    return [n for level in levels(node) for n in level]


def trees(text: str) -> Iterator[ast.Module]:
    """The file's syntax tree; of a long file one for each piece of whole statements, so that no tree outgrows its piece.

    A piece ends before a line that begins a statement. One that does not parse (it may end within a string or bracket)
    is tried again with twice the length; if the last one does not parse, the file does not.
    """
    begin, lines = 0, 0
    while True:
        size, tree = PIECE, None
        while tree is None:
            end = None if begin + size >= len(text) else _BEGIN.search(text, begin + size)
            stop = end.end() if end else len(text)
            try:
                tree = ast.parse("\n" * lines + text[begin:stop] if begin else text[:stop])
            except SyntaxError:
                if stop == len(text):
                    ast.parse(text)
                    raise
                size *= 2
        yield tree
        if stop == len(text):
            return
        lines += text[begin:stop].replace("\r\n", "\n").replace("\r", "\n").count("\n")
        begin = stop


def path_of(node: ast.AST | None) -> str:
    """``a.b.c`` of a chain of attributes on a name, else nothing."""
    if node.__class__ is ast.Name:
        return node.id
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def called(node: ast.AST | None) -> str:
    """Last name of what a call calls."""
    return path_of(node.func).rpartition(".")[2] if isinstance(node, ast.Call) else ""


def text_of(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def argument(call: ast.Call, name: str) -> ast.AST | None:
    return next((k.value for k in call.keywords if k.arg == name), None)


def source_of(node: ast.AST) -> str:
    """The node as source text."""
    return node.id if node.__class__ is ast.Name else ast.unparse(node)


def dependency(node: ast.AST | None) -> str | None:
    """Target of ``Depends(...)``; None for anything else, and an empty string for a target without a name."""
    if called(node) not in DEPENDENCY_CALLS:
        return None
    target = node.args[0] if node.args else argument(node, "dependency")
    return OWN_TYPE if target is None else path_of(target)


def dependencies(node: ast.AST | None) -> list[str]:
    items = node.elts if isinstance(node, (ast.List, ast.Tuple)) else []
    return [d for d in map(dependency, items) if d and d != OWN_TYPE]


def types_in(node: ast.AST | None) -> list[str]:
    """Names in a type expression, quoted ones too."""
    if node is None or dependency(node) is not None:
        return []
    if name := path_of(node):
        return [name]
    if (quoted := text_of(node)) is not None:
        try:
            return types_in(ast.parse(quoted, mode="eval").body)
        except (SyntaxError, ValueError):
            return []
    return [t for child in ast.iter_child_nodes(node) for t in types_in(child)]


def annotated(node: ast.AST | None) -> tuple[ast.AST | None, list[ast.AST]]:
    """Type and metadata of ``Annotated[type, ...]``; of anything else itself and none."""
    if isinstance(node, ast.Subscript) and path_of(node.value).rpartition(".")[2] == "Annotated" and isinstance(node.slice, ast.Tuple):
        return node.slice.elts[0], node.slice.elts[1:]
    return node, []


def assigned(node: ast.stmt) -> list[str]:
    targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
    return [t.id for t in targets if isinstance(t, ast.Name)]


class FileFacts:
    """Collects the rows of one file, in the order in which their links are made."""

    def __init__(self, module: str, is_package: bool) -> None:
        self.passes: defaultdict[tuple[int, int], list[tuple]] = defaultdict(list)
        self.begun = False
        self.package = module.split(".") if is_package else module.split(".")[:-1]

    def say(self, kind: str, owner: str | None = None, name: str | None = None, ref: str | None = None, value: str | None = None, extra: str | None = None, flag: bool | None = None, line: int | None = None) -> None:
        self.rows.append((kind, owner, name, ref, value, extra, flag, line))

    def read(self, tree: ast.Module) -> None:
        """Add the facts of a file's next piece. Each pass, and each depth of one, keeps its own: pieces give the order of the whole file."""
        nodes = [[n for n in level if n.__class__ in _SAYING] for level in levels(tree)]
        scopes = [*([] if self.begun else [tree]), *(n for level in nodes for n in level if isinstance(n, _SCOPES))]
        heads = [s.body[0] for s in scopes if s.body]
        self.docstrings = {id(head.value) for head in heads if isinstance(head, ast.Expr)}
        self.begun = self.begun or bool(tree.body)
        for depth, level in enumerate(nodes):
            self.rows = self.passes[0, depth]
            self.imports(level)
        self.rows = self.passes[1, 0]
        self.definitions(tree.body, "")
        self.rows = self.passes[2, 0]
        for node in tree.body:
            self.statement(node)
        for depth, level in enumerate(nodes):
            self.rows = self.passes[3, depth]
            for node in level:
                self.anywhere(node)

    def all_rows(self) -> Iterator[tuple]:
        return chain.from_iterable(self.passes[k] for k in sorted(self.passes))

    def imports(self, nodes: list[ast.AST]) -> None:
        for node in nodes:
            if isinstance(node, ast.Import):
                for a in node.names:
                    whole = a.name if a.asname else a.name.partition(".")[0]
                    self.say("import", name=a.asname or whole, ref=whole)
            elif isinstance(node, ast.ImportFrom):
                above = self.package[: max(0, len(self.package) - node.level + 1)] if node.level else []
                source = ".".join([*above, *([node.module] if node.module else [])])
                for a in node.names:
                    if a.name != "*":
                        self.say("import", name=a.asname or a.name, ref=source, value=a.name)

    def definitions(self, body: list[ast.stmt], inside: str) -> None:
        for node in body:
            if isinstance(node, _FUNCTIONS):
                self.function(node, inside + node.name)
            elif isinstance(node, ast.ClassDef):
                self.class_(node, inside + node.name)
                self.definitions(node.body, f"{inside}{node.name}.")

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, me: str) -> None:
        self.say("function", name=me, flag=isinstance(node, ast.AsyncFunctionDef), line=node.lineno)
        spec = node.args
        plain = [*spec.posonlyargs, *spec.args]
        defaults = {} if not spec.defaults and not spec.kwonlyargs else dict(zip([a.arg for a in reversed(plain)], reversed(spec.defaults), strict=False)) | {a.arg: d for a, d in zip(spec.kwonlyargs, spec.kw_defaults, strict=True)}
        for arg in [*plain, *spec.kwonlyargs]:
            if arg.arg not in ("self", "cls"):
                self.param(me, arg, defaults.get(arg.arg))
        for t in types_in(node.returns):
            self.say("return_ref", owner=me, ref=t)
        for mark in node.decorator_list:
            if isinstance(mark, ast.Call) and isinstance(mark.func, ast.Attribute):
                self.decorator(me, mark, path_of(mark.func.value), mark.func.attr)
        nodes = [n for statement in node.body for n in walk(statement)]
        made = [n for n in nodes if n.__class__ is ast.Call]
        calls = {path_of(n.func) for n in made if dependency(n) is None} - {""}
        loaded = {path_of(n) for n in nodes if n.__class__ in (ast.Name, ast.Attribute) and isinstance(n.ctx, ast.Load)} - {""}
        for kind, names in (("call", calls), ("name", loaded - calls)):
            for name in sorted(names):
                self.say(kind, owner=me, ref=name)
        self.texts(nodes, me)
        for n in made:
            if called(n) in TEMPLATE_CALLS:
                given = [text_of(a) for a in [*n.args, *(k.value for k in n.keywords if k.arg in ("name", "template_name"))]]
                for template in [t for t in given if t and t.lower().endswith(TEMPLATE_ENDINGS)][:1]:
                    self.say("template", owner=me, value=template)

    def texts(self, nodes: list[ast.AST], me: str | None) -> None:
        for n in nodes:
            if n.__class__ not in (ast.Constant, ast.JoinedStr):
                continue
            text = text_of(n) if id(n) not in self.docstrings else None
            if isinstance(n, ast.JoinedStr):
                text = "".join(str(v.value) if isinstance(v, ast.Constant) else "?" for v in n.values)
            if text and len(text.split(None, 1)) > 1:
                self.say("text", owner=me, value=text)

    def param(self, me: str, arg: ast.arg, default: ast.AST | None) -> None:
        type_, marks = annotated(arg.annotation)
        marks = [*marks, default]
        sources = [called(m) for m in marks if called(m) in PARAM_SOURCES]
        self.say("param", owner=me, name=arg.arg, value=sources[-1] if sources else None)
        types = types_in(type_)
        for target in map(dependency, marks):
            if target is not None:
                own = target in ("", OWN_TYPE)
                self.say("param_dep", owner=me, name=arg.arg, ref=(types[0] if types else None) if own else target)
        for t in types:
            self.say("param_type", owner=me, name=arg.arg, ref=t)

    def decorator(self, me: str, mark: ast.Call, on: str, verb: str) -> None:
        if verb == "middleware" and on:
            self.say("middleware_owner", owner=me, ref=on)
        path = text_of(mark.args[0] if mark.args else argument(mark, "path"))
        if path is None or verb not in (*ROUTE_METHODS, "api_route", "websocket"):
            return
        listed = [text_of(e) for e in getattr(argument(mark, "methods"), "elts", [])]
        methods = {"websocket": ["WS"], "api_route": [m.upper() for m in listed if m] or ["GET"]}.get(verb, [verb.upper()])
        model = argument(mark, "response_model")
        for method in methods:
            self.say("route", owner=me, name=method, ref=on or None, value=path, extra=source_of(model) if model is not None else None, line=mark.lineno)
            for d in dependencies(argument(mark, "dependencies")):
                self.say("route_dep", owner=me, name=method, ref=d)
        for t in types_in(model):
            self.say("route_model", owner=me, ref=t)

    def class_(self, node: ast.ClassDef, me: str) -> None:
        facts = {name: item.value for item in node.body for name in assigned(item) if name.startswith("__")}
        abstract = facts.get("__abstract__")
        is_table = [k.value for k in node.keywords if k.arg == "table"]
        self.say("class", name=me, value=text_of(facts.get("__tablename__")), flag=isinstance(abstract, ast.Constant) and abstract.value is True, extra=ast.unparse(is_table[-1]) if is_table else None, line=node.lineno)
        for k in node.keywords:
            if k.arg:
                self.say("keyword", owner=me, name=k.arg, value=ast.unparse(k.value))
        for base in filter(None, map(path_of, node.bases)):
            self.say("base", owner=me, ref=base)
        for item in node.body:
            names = assigned(item)
            if len(names) != 1 or (isinstance(item, ast.Assign) and len(item.targets) > 1):
                continue
            type_ = getattr(item, "annotation", None)
            for t in types_in(type_):
                self.say("field_ref", owner=me, ref=t)
            if names[0].startswith("__"):
                continue
            if called(item.value) == "relationship":
                for t in types_in(item.value.args[0] if item.value.args else type_):
                    if t not in ("Mapped", "list", "List", "Optional", "set"):
                        self.say("relationship_ref", owner=me, ref=t)
                self.say("field", owner=me, name=names[0])
            elif type_ is not None or called(item.value) in COLUMN_CALLS:
                self.say("field", owner=me, name=names[0])
        for n in walk(node):
            key = text_of(n.args[0]) if called(n) == "ForeignKey" and n.args else None
            if key and "." in key:
                self.say("foreign_table", owner=me, value=key.rpartition(".")[0].lower())

    def statement(self, node: ast.stmt) -> None:
        """A statement of the module's own body."""
        if isinstance(node, _SCOPES):
            self.say("symbol", name=node.name)
            return
        names, value = assigned(node), getattr(node, "value", None)
        if isinstance(node, ast.TypeAlias):
            names = [node.name.id]
        for name in names:
            self.say("symbol", name=name)
            for target in filter(None, map(dependency, annotated(value)[1])):
                self.say("alias_dep", owner=name, ref=target, line=node.lineno)
            if isinstance(node, ast.TypeAlias):
                continue
            if called(value) in ("FastAPI", "APIRouter"):
                prefix = text_of(argument(value, "prefix")) or text_of(argument(value, "root_path")) or ""
                self.say("variable", name=name, ref="App" if called(value) == "FastAPI" else "Router", value=prefix, line=node.lineno)
                for d in dependencies(argument(value, "dependencies")):
                    self.say("variable_dep", owner=name, ref=d)
            elif called(value) in BASE_FACTORIES:
                self.say("orm_base", name=name)
        nodes = walk(node)
        for name in sorted({path_of(n) for n in nodes if isinstance(n, (ast.Name, ast.Attribute)) and isinstance(n.ctx, ast.Load)} - {""}):
            self.say("module_ref", ref=name)
        self.texts(nodes, None)

    def anywhere(self, node: ast.AST) -> None:
        """What counts at any depth: calls on apps and routers, and what the file-local checks read."""
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.args:
            on, target = path_of(node.func.value), path_of(node.args[0])
            if on and target and node.func.attr == "include_router":
                self.say("include", ref=on, name=target, value=text_of(argument(node, "prefix")) or "", line=node.lineno)
                for d in dependencies(argument(node, "dependencies")):
                    self.say("include_dep", name=target, owner=on, ref=d)
            elif on and target and node.func.attr == "add_middleware":
                self.say("add_middleware", ref=on, name=target, line=node.lineno)
        elif isinstance(node, ast.AnnAssign):
            self.say("annotation", value=source_of(node.annotation), line=node.lineno)
        elif isinstance(node, ast.ClassDef):
            self.say("any_class", name=node.name, line=node.lineno)
            for base in node.bases:
                if isinstance(base, ast.Name):
                    self.say("any_base", owner=node.name, ref=base.id)
            for item in node.body:
                if isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name):
                    self.say("any_field", owner=node.name, name=item.target.id, value=source_of(item.annotation), extra=ast.unparse(item.value) if item.value else None, line=node.lineno)
                for mark in item.decorator_list if isinstance(item, _FUNCTIONS) else []:
                    if isinstance(mark, ast.Call) and isinstance(mark.func, ast.Name) and mark.func.id in ("validator", "field_validator") and mark.args:
                        first = mark.args[0]
                        self.say("validator", owner=node.name, name=item.name, value=str(first.value) if isinstance(first, ast.Constant) else ast.unparse(first), line=node.lineno)
        elif isinstance(node, _FUNCTIONS):
            for arg in [*node.args.args, *node.args.kwonlyargs]:
                if arg.annotation:
                    self.say("annotation", owner=node.name, value=source_of(arg.annotation), line=node.lineno)
            for mark in node.decorator_list:
                if isinstance(mark, ast.Call) and isinstance(mark.func, ast.Attribute) and mark.func.attr in ROUTE_METHODS[:5]:
                    path = mark.args[0] if mark.args else None
                    shown = "unknown" if path is None else str(path.value) if isinstance(path, ast.Constant) else ast.unparse(path)
                    self.say("verb_decorator", owner=node.name, name=mark.func.attr.upper(), value=shown, flag=any(k.arg == "response_model" for k in mark.keywords), line=node.lineno)


def facts_of(content: bytes | str | None, module: str, is_package: bool) -> list[tuple]:
    """Facts of one file; one that does not parse says so in its module row and nothing else. Columns as of ``schemas.FACTS``, from kind on."""
    text = content.decode("utf-8", "replace") if isinstance(content, bytes) else content or ""
    facts = FileFacts(module, is_package)
    try:
        for tree in trees(text):
            facts.read(tree)
        error = None
    except SyntaxError as e:
        error = f"SyntaxError: {e.msg} (line {e.lineno})"
    except (ValueError, RecursionError, MemoryError) as e:
        error = f"{type(e).__name__}: {e}"
    head = ("module", None, module, None, error, None, None, None, -1)
    return [head, *(row + (n,) for n, row in enumerate(facts.all_rows()))] if error is None else [head]


def dealt_by_size(source_files: DataFrame, task_bytes: int = 4 << 20) -> DataFrame:
    """The files in partitions of about ``task_bytes``: a file that fills one has it to itself, so no other file waits for it.

    Worth its shuffle where few files hold many of the bytes. ``size`` counts, else the content's length.
    """
    size = F.coalesce(F.col("size") if "size" in source_files.columns else F.lit(None).cast("long"), F.octet_length("content").cast("long"), F.lit(0).cast("long"))
    sized = source_files.withColumn("__size", size)
    large = sized.where(F.col("__size") >= task_bytes).select("project_id", "path").distinct().orderBy("project_id", "path").collect()  # of total / task_bytes at most
    rest = sized.where(F.col("__size") < task_bytes).agg(F.sum("__size")).first()[0] or 0
    parts = max(1, -(-rest // task_bytes))
    own = source_files.sparkSession.createDataFrame([(r.project_id, r.path, parts + i) for i, r in enumerate(large)], "project_id string, path string, __own int")
    placed = source_files.join(F.broadcast(own), ["project_id", "path"], "left")
    slot = F.coalesce("__own", F.pmod(F.xxhash64("project_id", "path"), F.lit(parts)).cast("int"))
    return placed.repartitionById(parts + len(large), slot).select(*source_files.columns)


def extract_facts(source_files: DataFrame) -> DataFrame:
    """Facts (``schemas.FACTS``) of source files (project_id, path, content). No shuffle; see :func:`dealt_by_size` for uneven files.

    A file that does not parse gives one row with the error. A null content is an empty file.
    """
    files = source_files.select("project_id", "path", module_name(F.col("path"), F.col("project_id")).alias("module"), F.col("path").rlike(r"(^|/)__init__\.py$").alias("is_package"), "content")
    own = [f.name for f in FACTS.fields[4:]]
    kinds = {"flag": pa.bool_(), "line": pa.int32(), "ord": pa.int32()}

    def made(batch: pa.RecordBatch, rows: list[tuple], taken: list[int]) -> pa.RecordBatch:
        keys = [batch.column(c).take(pa.array(taken, pa.int64())) for c in ("project_id", "path", "module", "is_package")]
        columns = list(zip(*rows, strict=True)) or [()] * len(own)
        return pa.RecordBatch.from_arrays([*keys, *(pa.array(x, kinds.get(c, pa.string())) for c, x in zip(own, columns, strict=True))], [f.name for f in FACTS.fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, taken = [], []
            for i, (content, module, is_package) in enumerate(zip(*(batch.column(c) for c in ("content", "module", "is_package")), strict=True)):
                facts = facts_of(content.as_py(), module.as_py(), is_package.as_py())
                for at in range(0, len(facts), BATCH_FACTS):
                    part = facts[at : at + BATCH_FACTS]
                    rows += part
                    taken += [i] * len(part)
                    if len(rows) >= BATCH_FACTS:
                        yield made(batch, rows, taken)
                        rows, taken = [], []
            yield made(batch, rows, taken)

    return files.mapInArrow(each, FACTS)
