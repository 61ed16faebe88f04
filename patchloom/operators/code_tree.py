"""What a parser finds in a file, whatever its language."""

from __future__ import annotations

from dataclasses import dataclass, field

from patchloom.operators.code_lex import Tokens

Scope = tuple[str, str, int, int, int]  # type, name, first line, last line, depth


@dataclass
class Import:
    """One import: ``names`` is None where a whole module is meant."""

    module: str
    names: list[str] | None = None
    alias: str | None = None
    name_aliases: list[tuple[str, str]] = field(default_factory=list)
    is_star: bool = False
    is_relative: bool = False
    level: int = 0


@dataclass
class Parsed:
    """What a file holds. Symbols are (line, name, role), role being use or definition."""

    scopes: list[Scope] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    symbols: list[tuple[int, str, str]] = field(default_factory=list)
    top_level: list[tuple[str, int, int]] = field(default_factory=list)


def finished(t: Tokens, scopes: list[tuple[str, str, int, int, int]], imports: list[Import], symbols: list[tuple[int, str, str]]) -> Parsed:
    """Scopes (kind, name, first and last token, token whose line it starts on) with their lines and depths."""
    out = Parsed(imports=imports, symbols=symbols)
    stack: list[int] = []
    for kind, name, first, last, line in sorted(scopes, key=lambda s: (s[2], -s[3])):
        while stack and stack[-1] < first:
            stack.pop()
        stack.append(last)
        out.scopes.append((kind, name, t.line[line], t.stop[last], len(stack)))
        if len(stack) == 1 and name[:1] != "<":
            out.top_level.append((name, t.line[line], t.stop[last]))
    return out
