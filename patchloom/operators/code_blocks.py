"""Scopes, imports and names of files in languages whose blocks end in a word: Ruby and Elixir.

Words that open a block and those that end one are matched on a stack. A word opens only where a statement or a value can begin: after a value it
is a modifier. Definitions without a block (``def x = 1``, ``def f(x), do: x``) end with their expression.
"""

from __future__ import annotations

import re

from patchloom.operators.code_lex import Tokens
from patchloom.operators.code_tree import Import, Parsed, finished

#: Words of the two languages.
RUBY_WORDS = frozenset((
    "alias", "and", "begin", "BEGIN", "break", "case", "class", "def", "defined?", "do", "else", "elsif", "end", "END", "ensure", "false", "for", "if", "in", "module",
    "next", "nil", "not", "or", "redo", "rescue", "retry", "return", "self", "super", "then", "true", "undef", "unless", "until", "when", "while", "yield", "__FILE__",
    "__LINE__", "__dir__", "__method__",
))
RUBY_VALUES = frozenset((
    "break", "end", "false", "next", "nil", "redo", "retry", "return", "self", "super", "true", "yield", "__FILE__", "__LINE__", "__dir__", "__method__",
))
ELIXIR_SCOPES = {
    "defmodule": "module", "def": "function", "defp": "function", "defmacro": "macro", "defmacrop": "macro", "defguard": "guard", "defguardp": "guard", "defprotocol": "protocol", "defimpl": "implementation",
}
_STRING = re.compile(r"""(["'])((?:\\.|(?!\1).)*)\1""")


class Blocks:
    def __init__(self, t: Tokens):
        self.t, self.n = t, len(t)
        self.scopes: list[tuple[str, str, int, int, int]] = []
        self.imports: list[Import] = []
        self.defined: set[int] = set()
        self.skipped: set[int] = set()

    def text(self, k: int) -> str:
        return self.t.text[k] if 0 <= k < self.n else ""

    def kind(self, k: int) -> str:
        return self.t.kind[k] if 0 <= k < self.n else ""

    def match(self, k: int) -> int:
        return self.t.match[k] if self.t.match[k] >= 0 else self.n - 1

    def scope(self, kind: str, name: str, first: int, last: int) -> None:
        while last > first and self.kind(last) == "nl":
            last -= 1
        self.scopes.append((kind, name, first, last, first))

    def string(self, k: int) -> str | None:
        """What a quoted text at ``k`` holds."""
        found = _STRING.match(self.t.source, self.t.place[k]) if self.kind(k) == "str" else None
        return found[2] if found else None

    def next_line(self, k: int) -> int:
        """The first token after the line breaks from ``k`` on."""
        while self.kind(k) == "nl":
            k += 1
        return k


# --- Ruby -----------------------------------------------------------------------------------------------------------------------------------


class Ruby(Blocks):
    def word(self, k: int) -> str:
        """A keyword; not where it names a method."""
        return self.text(k) if self.kind(k) == "id" and self.text(k) in RUBY_WORDS and self.text(k - 1) not in (".", "&.", "::") and not (self.text(k - 1) == "def" and self.text(k) not in ("self",)) else ""

    def value_end(self, k: int) -> bool:
        kind, text = self.kind(k), self.text(k)
        if kind == "id":
            word = self.word(k)
            return not word or word in RUBY_VALUES
        return kind in ("num", "str", "var", "sym") or text in (")", "]", "}")

    def goes_on(self, k: int) -> bool:
        """Whether a line break at ``k`` is inside an expression."""
        if self.kind(k - 1) == "op" and self.text(k - 1) not in (")", "]", "}", ";") or self.word(k - 1) in ("and", "or", "not"):
            return True
        after = self.next_line(k)
        return self.text(after) in (".", "&.") and self.text(after + 1) != "."

    def name_of(self, k: int) -> tuple[int, str]:
        """After a constant's path at ``k``, and the path."""
        first = k
        if self.text(k) == "::":
            k += 1
        while self.kind(k) == "id" and self.text(k)[:1].isupper():
            k += 1
            if self.text(k) == "::":
                k += 1
            else:
                break
        return k, "".join(self.t.text[first:k])

    def definition(self, k: int, stack: list) -> None:
        """``def`` at ``k``."""
        at = k + 1
        while self.kind(at) == "nl":
            at += 1
        if self.text(at + 1) in (".", "::") and self.kind(at) in ("id", "var"):
            self.skipped.add(at) if self.text(at) == "self" else None
            at += 2
        name = self.text(at)
        if self.kind(at) == "id":
            self.defined.add(at)
        elif self.kind(at) == "attr":
            name = name[:-1]
        at += 1
        if self.kind(at - 1) == "op":  # operators as names: [], []=, ==, +@
            while not self.t.space[at] and self.kind(at) == "op" and self.text(at) not in ("(", ";"):
                name, at = name + self.text(at), at + 1
        elif self.text(at) == "=" and not self.t.space[at] and (self.text(at + 1) == "(" or self.t.space[at + 1] is False and self.kind(at + 1) == "id"):
            name, at = name + "=", at + 1
        if self.text(at) == "(":
            self.parameters(at + 1, self.match(at))
            at = self.match(at) + 1
        else:
            end = at
            while end < self.n and self.kind(end) != "nl" and self.text(end) not in (";", "="):
                end += 1
            if self.text(end) != "=" or end > at:
                end = at
                while end < self.n and self.kind(end) != "nl" and self.text(end) != ";":
                    end += 1
                self.parameters(at, end)
        if self.text(at) == "=":  # no block: the method is one expression
            stack.append(["endless", k, name, None])
            self.endless[self.expression_end(at + 1)] = True
            self.scope("method", name, k, self.expression_end(at + 1))
            stack.pop()
        else:
            stack.append(["method", k, name, None])

    def expression_end(self, k: int) -> int:
        """The last token of the expression that begins at ``k``; blocks inside it are whole."""
        depth, at = 0, k
        while at < self.n:
            if self.kind(at) == "nl" or self.text(at) == ";":
                if not depth and at > k and not (self.kind(at) == "nl" and self.goes_on(at)):
                    return at - 1
            elif self.text(at) in ("(", "[", "{") and self.t.match[at] > at:
                at = self.t.match[at]
            elif self.text(at) in (")", "]", "}") and not depth:
                return at - 1
            elif self.opens(at) or self.word(at) == "do":
                depth += 1
            elif self.word(at) == "end":
                depth -= 1
                if depth < 0:
                    return at - 1
            at += 1
        return self.n - 1

    def opens(self, k: int) -> bool:
        word = self.word(k)
        if word in ("if", "unless", "while", "until"):
            return not self.value_end(k - 1) or self.kind(k - 1) == "nl"
        return word in ("class", "module", "def", "case", "begin", "for")

    def parameters(self, a: int, b: int) -> None:
        """Names among the parameters from ``a`` to before ``b`` are definitions."""
        for k in range(a, min(b, self.n)):
            before = self.text(k - 1)
            if self.kind(k) == "id" and self.text(k) not in RUBY_WORDS and (k == a or before in (",", "(", "|", "*", "**", "&", ";") or self.kind(k - 1) == "nl"):
                self.defined.add(k)

    def block_parameters(self, k: int) -> None:
        """``|a, b|`` after the token at ``k``."""
        if self.text(k + 1) == "|":
            end = k + 2
            while end < self.n and self.text(end) != "|" and self.kind(end) != "nl":
                end += 1
            self.parameters(k + 2, end)

    def read(self) -> Parsed:
        t = self.t
        self.endless: dict[int, bool] = {}
        stack: list[list] = []  # what was opened, its token, its name, the line of a loop that may have a do
        for k in range(self.n):
            text, word = t.text[k], self.word(k)
            if word == "class" or word == "module":
                if self.text(k + 1) == "<<":
                    stack.append(["other", k, "", None])
                else:
                    end, name = self.name_of(k + 1)
                    if not name:
                        continue
                    if end == k + 2:
                        self.defined.add(k + 1)
                    stack.append([word, k, name, None])
            elif word == "def":
                self.definition(k, stack)
            elif word in ("if", "unless", "case", "begin") and self.opens(k):
                stack.append(["other", k, "", None])
            elif word in ("while", "until", "for") and self.opens(k):
                stack.append(["other", k, "", t.line[k]])
            elif word == "do":
                if stack and stack[-1][3] is not None and stack[-1][3] == t.line[k]:
                    stack[-1][3] = None
                    continue
                self.block_parameters(k)
                stack.append(["block", k, self.lambda_before(k), None])
            elif word == "end" and stack:
                kind, first, name, _ = stack.pop()
                if kind == "block":
                    if name != "":
                        self.scope("lambda", "<lambda>", name, k)
                    self.scope("block", "<block>", first, k)
                elif kind != "other":
                    self.scope(kind, name, first, k)
            elif text == "{" and t.kind[k] == "op":
                arrow = self.lambda_before(k)
                if arrow != "" or self.text(k - 1) == ")" or self.kind(k - 1) == "id" and (not self.word(k - 1) or self.word(k - 1) in ("super", "yield")):
                    self.block_parameters(k)
                    if arrow != "":
                        self.scope("lambda", "<lambda>", arrow, self.match(k))
                    self.scope("block", "<block>", k, self.match(k))
            elif text == "->" and self.text(k + 1) == "(":
                self.parameters(k + 2, self.match(k + 1))
            elif t.kind[k] == "id" and text in ("require", "require_relative", "load", "autoload") and self.text(k - 1) not in (".", "&.", "::", "def"):
                self.import_(k)
            if t.kind[k] == "id" and not word and self.text(k + 1) == "=" and self.text(k - 1) not in (".", "&.", "::", ",", "*") and self.text(k + 2) != "~":
                if k not in self.defined and not self.in_parameters(k):
                    self.defined.add(k)
        symbols = [(t.line[k], t.text[k], "definition" if k in self.defined else "use") for k in range(self.n) if self.is_symbol(k)]
        return finished(t, self.scopes, self.imports, symbols)

    def in_parameters(self, k: int) -> bool:
        return False

    def lambda_before(self, k: int) -> int | str:
        """The arrow of the lambda whose body opens at ``k``; empty where there is none."""
        p = k - 1
        if self.text(p) == ")" and self.t.match[p] > 0 and self.text(self.t.match[p] - 1) == "->":
            return self.t.match[p] - 1
        while p > k - 12 and self.kind(p) in ("id", "op") and (self.kind(p) == "id" and not self.word(p) or self.text(p) in (",", "*", "&")):
            p -= 1
        return p if self.text(p) == "->" else ""

    def is_symbol(self, k: int) -> bool:
        if self.kind(k) != "id" or k in self.skipped or self.word(k):
            return False
        if k in self.defined:
            return True
        before = self.text(k - 1)
        if before in (".", "&."):
            return False
        return not (before == "::" and (not self.text(k)[:1].isupper() or self.text(k + 1) == "(" and not self.t.space[k + 1]))

    def import_(self, k: int) -> None:
        at = k + 1 + (self.text(k + 1) == "(")
        names = None
        if self.text(k) == "autoload" and self.kind(at) == "sym":
            names, at = [self.text(at)[1:]], at + 2
        module = self.string(at)
        if module is not None:
            self.imports.append(Import(module, names, is_relative=self.text(k) == "require_relative" or self.text(k) != "autoload" and module.startswith(("./", "../"))))


# --- Elixir ---------------------------------------------------------------------------------------------------------------------------------


class Elixir(Blocks):
    def word(self, k: int) -> str:
        return self.text(k) if self.kind(k) == "id" and self.text(k - 1) != "." else ""

    def goes_on(self, k: int) -> bool:
        """Whether a line break at ``k`` is inside an expression."""
        if self.kind(k - 1) == "op" and self.text(k - 1) not in (")", "]", "}", ";") or self.kind(k - 1) == "attr" or self.word(k - 1) in ("when", "and", "or", "in", "not"):
            return True
        after = self.next_line(k)
        return self.text(after) in ("|>", "<>", "++", "||", "&&", "|", "when", "and", "or", "=", "->", "do") and (self.kind(after) == "op" or self.word(after) != "") or self.text(after) == "do:" or self.text(after) == ","

    def call_end(self, k: int) -> tuple[int, int]:
        """Of a call at ``k``: its ``do`` (or ``do:``), -1 without one, and the last token of what stands on its line otherwise."""
        at = k + 1
        while at < self.n:
            if self.t.match[at] > at:
                at = self.t.match[at]
            elif self.word(at) == "do" or self.text(at) == "do:":
                return at, at
            elif self.word(at) == "fn":
                at = self.block_end(at)
            elif self.kind(at) == "nl" and not self.goes_on(at) or self.text(at) in (")", "]", "}", ";") or self.word(at) == "end":
                return -1, at - 1
            at += 1
        return -1, self.n - 1

    def block_end(self, k: int) -> int:
        """The ``end`` of the block that opens at ``k``."""
        return self.ends.get(k, self.n - 1)

    def expression_end(self, k: int) -> int:
        at = self.next_line(k)
        while at < self.n:
            if self.t.match[at] > at:
                at = self.t.match[at]
            elif self.word(at) in ("do", "fn") and at in self.ends:
                at = self.ends[at]
            elif self.kind(at) == "nl" and not self.goes_on(at) or self.text(at) in (")", "]", "}", ";") or self.word(at) == "end":
                return at - 1
            at += 1
        return self.n - 1

    def alias(self, k: int) -> tuple[int, str]:
        """After the module name at ``k``, and the name."""
        first = k
        if not (self.kind(k) == "id" and (self.text(k)[:1].isupper() or self.text(k) == "__MODULE__")):
            return k, ""
        k += 1
        while self.text(k) == "." and self.kind(k + 1) == "id" and self.text(k + 1)[:1].isupper():
            k += 2
        return k, "".join(self.t.text[first:k])

    def read(self) -> Parsed:
        t = self.t
        self.ends: dict[int, int] = {}
        stack: list[int] = []
        for k in range(self.n):
            word = self.word(k)
            if word in ("do", "fn"):
                stack.append(k)
            elif word == "end" and stack:
                self.ends[stack.pop()] = k
        for k in range(self.n):
            word, before = self.word(k), self.text(k - 1)
            if word == "fn" and k in self.ends:
                self.scope("anonymous_function", "<fn>", k, self.ends[k])
            elif word in ELIXIR_SCOPES and (k == 0 or self.kind(k - 1) == "nl" or before in (";", "do", "->", "do:", "(", "else")) and self.kind(k + 1) in ("id", "op", "str", "sym"):
                self.definition(k, word)
            elif word in ("alias", "import", "require", "use") and (k == 0 or self.kind(k - 1) == "nl" or before in (";", "do", "->", "do:", "(")):
                self.directive(k, word)
        symbols = []
        for k in range(self.n):
            if self.kind(k) == "id" and k in self.defined:
                symbols.append((t.line[k], t.text[k], "definition"))
            elif self.kind(k) == "id" and t.text[k][:1].isupper() and self.text(k - 1) != ".":
                symbols.append((t.line[k], t.text[k], "use"))
        return finished(t, self.scopes, self.imports, symbols)

    def definition(self, k: int, word: str) -> None:
        do, last = self.call_end(k)
        first = k + 1 + (self.text(k + 1) == "(" and not self.t.space[k + 1])
        if do >= 0 and self.text(do) == "do":
            last = self.block_end(do)
            if do not in self.ends:
                return
        elif do >= 0:
            last = self.expression_end(do + 1)
        if word in ("defmodule", "defprotocol", "defimpl"):
            _, name = self.alias(first)
            if name:
                self.defined.add(first)
        else:
            name = self.text(first) if self.kind(first) == "id" else ""
            after = first + 1
            if self.text(after) == "(" and not self.t.space[after]:
                after = self.match(after) + 1
            if self.word(after) == "when" and word in ("defguard", "defguardp"):
                pass
            elif self.kind(after) == "op" and self.text(after) not in (",", ")", ";") or self.word(after) in ("when", "and", "or", "in"):
                name = ""  # the first argument is an operator with the head on its left, and has no name
            else:
                self.defined.add(first) if name else None
        self.scope(ELIXIR_SCOPES[word], name or "<anonymous>", k, last)

    def directive(self, k: int, word: str) -> None:
        first = k + 1 + (self.text(k + 1) == "(" and not self.t.space[k + 1])
        end, module = self.alias(first)
        if not module:
            return
        _, last = self.call_end(k)
        if word == "alias" and self.text(end) == "." and self.text(end + 1) == "{":
            at = end + 2
            while at < self.match(end + 1):
                after, name = self.alias(at)
                if name:
                    self.imports.append(Import(f"{module}.{name}", [name.rpartition(".")[2]]))
                at = max(after, at + 1)
            return
        option = next((x for x in range(end, last + 1) if self.kind(x) == "attr" and self.text(x) in ("as:", "only:")), -1)
        if word == "alias" and option >= 0 and self.text(option) == "as:":
            self.imports.append(Import(module, None, self.alias(option + 1)[1] or None))
        elif word == "import" and option >= 0 and self.text(option) == "only:" and self.text(option + 1) == "[":
            self.imports.append(Import(module, [self.text(x)[:-1] for x in range(option + 2, self.match(option + 1)) if self.kind(x) == "attr"]))
        else:
            self.imports.append(Import(module, is_star=word == "import"))
