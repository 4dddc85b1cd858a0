"""Facts of Python sources: symbols, references, calls, imports, decorators, control flow, definitions, literals, comments.

Each file is parsed once by a map over partitions; every relation is a filter of the tagged rows.  A file that doesn't parse
gives one row of relation `error`, and no other.
"""

from __future__ import annotations

import ast
import io
import json
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave import schema

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
LITERALS = "file_path string, line long, col long, end_line long, end_col long, value string"
COMMENTS = "file_path string, line long, col long, value string"


class Extractor(ast.NodeVisitor):
    """Rows (relation, fact) of one file."""

    def __init__(self, file_path: str, module: str, source: str):
        self.file, self.module, self.source = file_path, module, source
        self.rows: list[tuple[str, dict]] = []
        self.scope: list[tuple[str, str]] = []  # (name, class or function)
        self.names: dict[str, str] = {}
        self.events = self.calls = 0
        self.blocks: dict[int, int] = {}  # statement to block, of the function that is visited
        self.block: int | None = None

    def visit(self, node: ast.AST) -> None:
        if isinstance(node, ast.stmt) and id(node) in self.blocks:
            before, self.block = self.block, self.blocks[id(node)]
            super().visit(node)
            self.block = before
        else:
            super().visit(node)

    def add(self, relation: str, **fact) -> None:
        self.rows.append((relation, fact))

    def qualified(self, name: str = "") -> str:
        return ".".join(x for x in (self.module, *(n for n, _ in self.scope), name) if x)

    @property
    def function(self) -> str | None:
        for k in range(len(self.scope), 0, -1):
            if self.scope[k - 1][1] == "function":
                return ".".join(x for x in (self.module, *(n for n, _ in self.scope[:k])) if x)
        return None

    def run(self) -> list[tuple[str, dict]]:
        tree = ast.parse(self.source)
        for node in tree.body:
            if isinstance(node, (*FUNCTIONS, ast.ClassDef)):
                self.names[node.name] = self.qualified(node.name)
            for alias in node.names if isinstance(node, (ast.Import, ast.ImportFrom)) else ():
                base = "." * getattr(node, "level", 0) + (getattr(node, "module", None) or "")
                target = f"{base}.{alias.name}".lstrip(".") if isinstance(node, ast.ImportFrom) else alias.name
                self.names[alias.asname or alias.name.split(".")[0]] = target if alias.asname or isinstance(node, ast.ImportFrom) else alias.name.split(".")[0]
        self.exports(tree)
        self.visit(tree)
        seen: set[tuple] = set()  # relations are sets
        return [x for x in self.rows if (key := (x[0], *x[1].values())) not in seen and not seen.add(key)]

    def exports(self, tree: ast.Module) -> None:
        for node in tree.body:
            if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
                for e in node.value.elts:
                    if isinstance(e, ast.Constant) and isinstance(e.value, str):
                        self.add("exported_symbol", file_path=self.file, qualified_name=f"{self.module}.{e.value}")

    # -- definitions -----------------------------------------------------
    def define(self, node, kind: str) -> None:
        parent = self.qualified() if self.scope else None
        qn = self.qualified(node.name)
        self.add("symbol", qualified_name=qn, file_path=self.file, name=node.name, kind=kind, line=node.lineno, end_line=node.end_lineno, parent=parent)
        returns = ast.unparse(node.returns) if getattr(node, "returns", None) else None
        signature = f"({ast.unparse(node.args)})" if isinstance(node, FUNCTIONS) else None
        marks = [ast.unparse(d) for d in node.decorator_list]
        self.add(
            "search_symbol", file_path=self.file, module_qualified_name=qn, name=node.name, qualified_name=qn, kind=kind, line=node.lineno,
            end_line=node.end_lineno, depth=len(self.scope), parent=parent, signature=signature, returns=returns, decorators=",".join(marks),
        )
        for d in node.decorator_list:
            self.add("decorator_on", symbol_qn=qn, decorator=dotted(d.func if isinstance(d, ast.Call) else d) or ast.unparse(d), file_path=self.file)
            self.visit(d)
        if returns:
            self.add("type_binding", symbol_qn=qn, file_path=self.file, line=node.lineno, binding_kind="annotation", type_str=returns)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:  # noqa: N802
        self.define(node, "class")
        for base in node.bases:
            self.visit(base)
        self.scope.append((node.name, "class"))
        for x in node.body:
            self.visit(x)
        self.scope.pop()

    def visit_FunctionDef(self, node) -> None:  # noqa: N802
        method = bool(self.scope) and self.scope[-1][1] == "class"
        self.define(node, ("async_" if isinstance(node, ast.AsyncFunctionDef) else "") + ("method" if method else "function"))
        self.scope.append((node.name, "function"))
        qn = self.qualified()
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *filter(None, (node.args.vararg, node.args.kwarg))]
        for a in args:
            if a.annotation:
                self.add("type_binding", symbol_qn=f"{qn}.{a.arg}", file_path=self.file, line=a.lineno, binding_kind="annotation", type_str=ast.unparse(a.annotation))
        flow = Flow(self, qn)
        flow.build(node)
        before = self.blocks, self.block
        self.blocks, self.block = flow.block_of, 0
        for x in node.body:
            self.visit(x)
        self.blocks, self.block = before
        self.scope.pop()

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    # -- references ------------------------------------------------------
    def reference(self, name: str | None, node: ast.AST, kind: str) -> None:
        if not name:
            return
        head, _, rest = name.partition(".")
        qn = self.names.get(head, f"{self.module}.{head}" if head not in BUILTINS else head) + (f".{rest}" if rest else "")
        self.add("reference", symbol_qn=qn, file_path=self.file, line=node.lineno, col=node.col_offset, ref_kind=kind, func_qn=self.function, block_id=self.block if self.function else None)
        if self.function is None:
            self.add("module_level_ref", symbol_qn=qn, file_path=self.file, line=node.lineno)
        elif self.block is not None:
            self.add("ref_by_block", file_path=self.file, func_qn=self.function, block_id=self.block, symbol_qn=qn)
            member = name.rpartition(".")[2]
            if kind != "call" and rest and member.startswith("_") and not member.endswith("__"):
                self.add("noncall_private_member_ref", file_path=self.file, func_qn=self.function, block_id=self.block, member_name=member)
        if kind == "call":
            self.add("call", caller_qn=self.function or f"{self.module}.<module>", callee_qn=qn, file_path=self.file, line=node.lineno, col=node.col_offset, func_qn=self.function, block_id=self.block if self.function else None)
            if rest and self.function:
                receiver, _, method = name.rpartition(".")
                self.add("method_call", file_path=self.file, func_qn=self.function, receiver=receiver, method=method, block_id=self.block or 0, line=node.lineno)

    def visit_Call(self, node: ast.Call) -> None:  # noqa: N802
        name = dotted(node.func)
        self.reference(name, node, "call")
        if name is None:
            self.visit(node.func)
        for x in (*node.args, *(k.value for k in node.keywords)):
            self.visit(x)

    def visit_Name(self, node: ast.Name) -> None:  # noqa: N802
        self.reference(node.id, node, "read" if isinstance(node.ctx, ast.Load) else "write")

    def visit_Attribute(self, node: ast.Attribute) -> None:  # noqa: N802
        name = dotted(node)
        if name:
            self.reference(name, node, "read" if isinstance(node.ctx, ast.Load) else "write")
        else:
            self.visit(node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:  # noqa: N802
        name = dotted(node.target)
        if name:
            self.add("type_binding", symbol_qn=self.qualified(name), file_path=self.file, line=node.lineno, binding_kind="annotation", type_str=ast.unparse(node.annotation))
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:  # noqa: N802
        for a in node.names:
            self.add("import", importing_file=self.file, imported_module=a.name, imported_name="", line=node.lineno, alias=a.asname)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:  # noqa: N802
        module = relative(self.module, node.level, node.module or "")
        for a in node.names:
            self.add("import", importing_file=self.file, imported_module=module, imported_name=a.name, line=node.lineno, alias=a.asname)


BUILTINS = frozenset(dir(__builtins__) if not isinstance(__builtins__, dict) else __builtins__)


def relative(module: str, level: int, name: str) -> str:
    """Module that an import of `name` with that many dots means inside `module`."""
    if not level:
        return name
    parts = module.split(".")[: -level or None]
    return ".".join([*parts, name] if name else parts)


def dotted(node: ast.AST) -> str | None:
    """a.b.c of a chain of attributes on a name."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else None


class Flow:
    """Blocks, edges, definitions and uses of one function.

    Blocks are numbered in order of creation: 0 is the entry, 1 the exit.
    """

    def __init__(self, out: Extractor, qn: str):
        self.out, self.qn = out, qn
        self.blocks: dict[int, list[ast.stmt]] = {0: [], 1: []}
        self.edges: set[tuple[int, int, str]] = set()
        #: Open loops (head, after), protected bodies (handlers) and bodies with a finally block (its entry, jumps that wait for it).
        self.frames: list[tuple[str, object, object]] = []
        self.block_of: dict[int, int] = {}

    def new(self) -> int:
        self.blocks[len(self.blocks)] = []
        return len(self.blocks) - 1

    def edge(self, a: int | None, b: int, kind: str = "fallthrough") -> None:
        if a is not None:
            self.edges.add((a, b, kind))

    def jump(self, at: int | None, what: str) -> None:
        """Leaves block `at` by return, raise, break or continue; open finally blocks are gone through first."""
        for kind, a, b in reversed(self.frames):
            if kind == "finally":
                self.edge(at, a, "finally")
                b.add(what)
                return
            if kind == "loop" and what in ("break", "continue"):
                self.edge(at, b if what == "break" else a, "jump")
                return
            if kind == "try" and what == "raise":
                for h in a:
                    self.edge(at, h, "exception")
                return
        self.edge(at, 1, "exception" if what == "raise" else "jump")

    def may_raise(self, at: int) -> None:
        """Any statement of a protected body may raise."""
        if any(kind != "loop" for kind, _, _ in self.frames):
            self.jump(at, "raise")

    def build(self, node) -> None:
        self.edge(self.body(node.body, 0), 1)
        self.block_of = {id(s): b for b, statements in self.blocks.items() for s in statements}
        out = self.out
        after: dict[int, list[int]] = {}
        for a, b, _ in self.edges:
            after.setdefault(a, []).append(b)
        live, todo = {0}, [0]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in live:
                    live.add(b)
                    todo.append(b)
        for b in sorted(live):
            out.add("reachable_block", file_path=out.file, func_qn=self.qn, block_id=b)
        self.events(node, after)
        for b in self.blocks:
            out.add("cfg_block", file_path=out.file, func_qn=self.qn, block_id=b, is_entry=b == 0, is_exit=b == 1)
            lines = [s.lineno for s in self.blocks[b]]
            if lines:
                out.add("source_loc", file_path=out.file, loc_kind="block", loc_id=f"{self.qn}:{b}", line=min(lines), col=0, end_line=max(lines), rel_line=min(lines) - node.lineno)
        for a, b, kind in sorted(self.edges):
            out.add("cfg_edge", file_path=out.file, func_qn=self.qn, from_block=a, to_block=b, edge_kind=kind, from_line=self.line(a), to_line=self.line(b))
        defs, uses = [], []
        for b, statements in self.blocks.items():
            for s in statements:
                for n in own_nodes(s):
                    if isinstance(n, ast.Name):
                        kind = {ast.Load: None, ast.Store: "write", ast.Del: "del"}[type(n.ctx)]
                        if kind and isinstance(s, ast.AugAssign) and n is s.target:
                            kind = "aug_write"
                            uses.append((n.id, b, n))
                        (defs.append((n.id, kind, b, n)) if kind else uses.append((n.id, b, n)))
        for name, kind, b, d in defs:
            for other, c, u in uses:
                if other == name:
                    out.add(
                        "def_use", file_path=out.file, func_qn=self.qn, var_name=name, kind=kind, def_block=b, use_block=c, def_line=d.lineno,
                        use_line=u.lineno, def_col=d.col_offset, use_col=u.col_offset,
                    )

    def line(self, b: int) -> int | None:
        return self.blocks[b][0].lineno if self.blocks[b] else -1

    def body(self, statements: list[ast.stmt], at: int | None) -> int | None:
        """Adds statements after block `at`; returns the block that control leaves by, or None."""
        for s in statements:
            if at is None:  # code behind a jump: a block without a way in
                at = self.new()
            at = self.statement(s, at)
        return at

    def statement(self, s: ast.stmt, at: int) -> int | None:
        self.blocks[at].append(s)
        if not isinstance(s, (ast.Try, ast.TryStar, ast.Pass, ast.Break, ast.Continue)):
            self.may_raise(at)
        if isinstance(s, ast.If):
            yes, after = self.new(), None
            self.edge(at, yes, "true_branch")
            left = self.body(s.body, yes)
            if s.orelse:
                no = self.new()
                self.edge(at, no, "false_branch")
                right = self.body(s.orelse, no)
                if left is None and right is None:
                    return None
                after = self.new()
                self.edge(right, after)
            else:
                after = self.new()
                self.edge(at, after, "false_branch")
            self.edge(left, after)
            return after
        if isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
            head, inside, after = self.new(), self.new(), self.new()
            self.blocks[head].append(self.blocks[at].pop())
            self.edge(at, head)
            self.edge(head, inside, "true_branch")
            self.frames.append(("loop", head, after))
            self.edge(self.body(s.body, inside), head, "back_edge")
            self.frames.pop()
            if s.orelse:
                other = self.new()
                self.edge(head, other, "false_branch")
                self.edge(self.body(s.orelse, other), after)
            else:
                self.edge(head, after, "false_branch")
            return after
        if isinstance(s, (ast.Try, ast.TryStar)):
            starts = [self.new() for _ in s.handlers]
            final, waiting = (self.new(), set()) if s.finalbody else (None, set())
            inside = self.new()
            self.edge(at, inside)
            if final is not None:
                self.frames.append(("finally", final, waiting))
            if starts:
                self.frames.append(("try", starts, None))
            end = self.body(s.body, inside)
            if starts:
                self.frames.pop()
            ends = [self.body(s.orelse, end) if s.orelse and end is not None else end]
            ends += [self.body(h.body, b) for h, b in zip(s.handlers, starts, strict=True)]
            falls = any(e is not None for e in ends)
            if final is None:
                if not falls:
                    return None
                after = self.new()
                for e in ends:
                    self.edge(e, after)
                return after
            self.frames.pop()
            for e in ends:
                self.edge(e, final, "finally")
            done = self.body(s.finalbody, final)
            for what in sorted(waiting):
                self.jump(done, what)
            if not falls or done is None:
                return None
            after = self.new()
            self.edge(done, after)
            return after
        if isinstance(s, (ast.With, ast.AsyncWith)):
            return self.body(s.body, at)
        if isinstance(s, ast.Match):
            after = self.new()
            for case in s.cases:
                b = self.new()
                self.edge(at, b, "true_branch")
                self.edge(self.body(case.body, b), after)
            self.edge(at, after, "false_branch")
            return after
        if isinstance(s, ast.Return):
            self.jump(at, "return")
            return None
        if isinstance(s, ast.Raise):
            self.jump(at, "raise")
            return None
        if isinstance(s, (ast.Break, ast.Continue)) and any(kind == "loop" for kind, _, _ in self.frames):
            self.jump(at, "break" if isinstance(s, ast.Break) else "continue")
            return None
        return at

    def events(self, node, after: dict[int, list[int]]) -> None:
        """Flow events of the function and the edges between them.

        Events in the order of evaluation: param_in; of each statement the uses, call_arg and call_result of each call, return, then
        definitions.  Edges: reaching from a definition to the uses it reaches, value inside a statement.
        """
        out = self.out
        own: dict[int, list[tuple[int, str, str | None]]] = {b: [] for b in self.blocks}  # block: event, role, variable

        def event(role: str, at: ast.AST, block: int, var: str | None = None, **more) -> int:
            out.events += 1
            k = out.events
            out.add(
                "flow_event", file_path=out.file, event_id=k, func_id=self.qn, func_name=node.name, func_start=node.lineno, role=role, var=var, access_path=var, block=block,
                start_byte=None, end_byte=None, start_line=at.lineno, start_col=at.col_offset, end_line=at.end_lineno, end_col=at.end_col_offset, ordinal=k,
                call_id=more.get("call_id"), arg_index=more.get("arg_index"), arg_name=more.get("arg_name"), text=ast.unparse(at),
            )
            own[block].append((k, role, var))
            return k

        def edge(a: int, b: int, kind: str) -> None:
            out.add("flow_edge", file_path=out.file, from_event=a, to_event=b, edge_kind=kind)

        def value(x: ast.AST, block: int) -> list[int]:
            """Events whose values an expression's value is made of."""
            if isinstance(x, ast.Name):
                return [event("use", x, block, x.id)] if isinstance(x.ctx, ast.Load) else []
            if isinstance(x, ast.Call):
                got = value(x.func, block) if not isinstance(x.func, ast.Name) else []
                out.calls += 1
                call, args = out.calls, []
                for k, arg in enumerate([*x.args, *(w.value for w in x.keywords)]):
                    made = value(arg, block)
                    name = x.keywords[k - len(x.args)].arg if k >= len(x.args) else None
                    a = event("call_arg", arg, block, call_id=call, arg_index=k, arg_name=name)
                    for m in made:
                        edge(m, a, "value")
                    args.append(a)
                result = event("call_result", x, block, call_id=call)
                for m in (*got, *args):
                    edge(m, result, "value")
                return [result]
            return [m for c in ast.iter_child_nodes(x) if not isinstance(c, (ast.stmt, ast.ExceptHandler, ast.match_case, ast.Lambda, ast.expr_context)) for m in value(c, block)]

        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *filter(None, (node.args.vararg, node.args.kwarg))]:
            event("param_in", a, 0, a.arg)
        for block, statements in self.blocks.items():
            for s in statements:
                if isinstance(s, (*FUNCTIONS, ast.ClassDef)):
                    continue
                made = value(s, block)
                if isinstance(s, ast.Return) and s.value is not None:
                    k = event("return", s, block)
                    for m in made:
                        edge(m, k, "value")
                for n in own_nodes(s):
                    if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                        if isinstance(s, ast.AugAssign) and n is s.target:
                            made.append(event("use", n, block, n.id))
                        k = event("def", n, block, n.id)
                        for m in made:
                            edge(m, k, "value")
        # Definitions that are live at each block's start, by rounds over the blocks that changed.
        last: dict[int, dict[str, int]] = {b: {v: k for k, role, v in evs if role in ("def", "param_in")} for b, evs in own.items()}
        start: dict[int, dict[str, set[int]]] = {b: {} for b in self.blocks}
        todo = list(self.blocks)
        while todo:
            b = todo.pop()
            ends = {v: ks for v, ks in start[b].items() if v not in last[b]} | {v: {k} for v, k in last[b].items()}
            for c in after.get(b, ()):
                grown = False
                for v, ks in ends.items():
                    have = start[c].setdefault(v, set())
                    if not ks <= have:
                        have |= ks
                        grown = True
                if grown:
                    todo.append(c)
        for b, evs in own.items():
            now = {v: set(ks) for v, ks in start[b].items()}
            for k, role, v in evs:
                if role == "use":
                    for d in sorted(now.get(v, ())):
                        edge(d, k, "reaching")
                elif role in ("def", "param_in"):
                    now[v] = {k}


def own_nodes(s: ast.stmt) -> Iterator[ast.AST]:
    """Nodes of a statement itself, without the statements and functions inside it."""
    todo: list[ast.AST] = [s]
    while todo:
        node = todo.pop()
        yield node
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (ast.stmt, ast.ExceptHandler, ast.match_case, ast.Lambda)):
                todo.append(child)


def facts_of(file_path: str, module: str, source: str) -> list[tuple[str, dict]]:
    try:
        return Extractor(file_path, module, source).run()
    except (SyntaxError, ValueError, RecursionError) as e:
        return [("error", {"file_path": file_path, "message": str(e)})]


def literals_of(file_path: str, source: str) -> list[tuple]:
    """String literals with their spans."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = [n for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str)]
    return [(file_path, n.lineno, n.col_offset, n.end_lineno, n.end_col_offset, n.value) for n in found]


def comments_of(file_path: str, source: str) -> list[tuple]:
    try:
        return [(file_path, *t.start, t.string) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT]
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return []


def extracted(files: DataFrame) -> DataFrame:
    """relation and fact (JSON) of every file (file_path, module_name, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(r, json.dumps(f)) for row in part.itertuples(index=False) for r, f in facts_of(row.file_path, row.module_name, row.content or "")]
            yield pd.DataFrame(rows, columns=["relation", "fact"])

    return files.select("file_path", "module_name", "content").mapInPandas(run, "relation string, fact string")


def extracted_with_cache(files: DataFrame, cache: DataFrame | None) -> DataFrame:
    """content_hash, file_path, relation, fact of every file; files whose path and content the cache (the same columns) holds aren't parsed again."""
    keyed = files.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
    key = ["file_path", "content_hash"]
    known = None if cache is None else cache.join(keyed.select(*key).distinct(), key, "left_semi").select("content_hash", "file_path", "relation", "fact")
    new = keyed if cache is None else keyed.join(cache.select(*key).distinct(), key, "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(row.content_hash, row.file_path, r, json.dumps(f)) for row in part.itertuples(index=False) for r, f in facts_of(row.file_path, row.module_name, row.content or "")]
            yield pd.DataFrame(rows, columns=["content_hash", "file_path", "relation", "fact"])

    fresh = new.select("content_hash", "file_path", "module_name", "content").mapInPandas(run, "content_hash string, file_path string, relation string, fact string")
    return fresh if known is None else known.unionByName(fresh)


def relation(facts: DataFrame, name: str) -> DataFrame:
    """One relation of the extracted facts."""
    return facts.where(F.col("relation") == name).select(F.from_json("fact", schema.RELATIONS[name]).alias("x")).select("x.*")


def _spans(files: DataFrame, of, kind: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for row in part.itertuples(index=False) for r in of(row.file_path, row.content or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    return files.select("file_path", "content").mapInPandas(run, kind)


def string_literals(files: DataFrame) -> DataFrame:
    return _spans(files, literals_of, LITERALS)


def comments(files: DataFrame) -> DataFrame:
    return _spans(files, comments_of, COMMENTS)


def linked(reference: DataFrame, block_ranges: DataFrame) -> DataFrame:
    """References with the innermost block (file_path, func_qn, block_id, line, end_line) of their function."""
    inside = (F.col("r.line") >= F.col("b.line")) & (F.col("r.line") <= F.col("b.end_line"))
    r, b = reference.alias("r"), block_ranges.alias("b")
    joined = r.join(b, (F.col("r.file_path") == F.col("b.file_path")) & (F.col("r.func_qn") == F.col("b.func_qn")) & inside, "left")
    keys = [F.col(f"r.{c}") for c in reference.columns if c != "block_id"]
    best = F.min_by(F.col("b.block_id"), F.struct(F.col("b.end_line") - F.col("b.line"), -F.col("b.block_id")))
    return joined.groupBy(*keys).agg(best.alias("block_id")).select(*reference.columns)
