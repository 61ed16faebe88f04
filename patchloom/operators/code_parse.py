"""Scopes, imports and names of source files, one file at a time: Python by its own parser, other languages from their tokens.

The readers of tokens know declarations, types and names; what they don't know they pass over, so they are no full grammars. Lines count from 1.
"""

from __future__ import annotations

import ast

from patchloom.operators.code_blocks import Elixir, Ruby
from patchloom.operators.code_braces import Go, Java, Php, Script
from patchloom.operators.code_lex import tokens
from patchloom.operators.code_tree import Import, Parsed, Scope

__all__ = ["READERS", "Import", "Parsed", "Scope", "parse"]

READERS = {"javascript": lambda t: Script(t, False), "typescript": lambda t: Script(t, True), "java": Java, "go": Go, "php": Php, "ruby": Ruby, "elixir": Elixir}


def parse(language: str, text: str) -> Parsed:
    """Parse a file; a language without a parser gives nothing, and of text that is broken in places the rest is read."""
    if language == "python":
        return _python(text)
    reader = READERS.get(language)
    return reader(tokens(language, text)).read() if reader else Parsed()


# --- Python -----------------------------------------------------------------------------------------------------------------------


#: Top-level blocks that are tried together where one alone is no valid code.
TOGETHER = 8


def _tree(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _python(text: str) -> Parsed:
    """A file as a whole; where it has errors, all of its top-level blocks that are valid."""
    out = Parsed()
    whole = _tree(text)
    if whole is not None:
        _read(out, whole, 0)
        return out
    lines = text.splitlines()
    starts = [k for k, line in enumerate(lines) if line[:1].strip() and line[0] not in "#)]}"]
    ends = [*starts[1:], len(lines)]
    at = 0
    while at < len(starts):
        for more in range(at, min(at + TOGETHER, len(starts))):
            tree = _tree("\n".join(lines[starts[at] : ends[more]]))
            if tree is not None:
                _read(out, tree, starts[at])
                at = more
                break
        at += 1
    return out


def _read(out: Parsed, tree: ast.Module, shift: int) -> None:
    """Add what a tree holds, its lines ``shift`` further down. Nodes are kept on a list of our own, so no depth is too much."""

    def first_line(node: ast.AST) -> int:
        return min([node.lineno, *(d.lineno for d in node.decorator_list)]) + shift

    todo: list[tuple[ast.AST, int]] = [(n, 0) for n in reversed(tree.body)]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            depth += 1
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            out.scopes.append((kind, node.name, first_line(node), node.end_lineno + shift, depth))
            out.symbols.append((node.lineno + shift, node.name, "definition"))
        elif isinstance(node, ast.Name):
            out.symbols.append((node.lineno + shift, node.id, "use" if isinstance(node.ctx, ast.Load) else "definition"))
        elif isinstance(node, ast.arg):
            out.symbols.append((node.lineno + shift, node.arg, "definition"))
        elif isinstance(node, ast.ExceptHandler) and node.name:
            out.symbols.append((node.lineno + shift, node.name, "definition"))
        todo += [(child, depth) for child in reversed(list(ast.iter_child_nodes(node)))]
    for node in tree.body:
        if isinstance(node, ast.Import):
            out.imports += [Import(a.name, alias=a.asname) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            star = any(a.name == "*" for a in node.names)
            names = [] if star else [a.name for a in node.names]
            out.imports.append(Import("." * node.level + (node.module or ""), names, None, [(a.name, a.asname) for a in node.names if a.asname], star, node.level > 0, node.level))
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            out.top_level.append((node.name, first_line(node), node.end_lineno + shift))
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            out.top_level += [(t.id, node.lineno + shift, node.end_lineno + shift) for t in targets if isinstance(t, ast.Name)]
