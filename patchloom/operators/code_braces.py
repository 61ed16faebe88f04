"""Scopes, imports and names of files in languages with braces: JavaScript, TypeScript, Java, Go, PHP.

Each reader goes once over the tokens. It gives every bracket a role when it meets what stands before it (parameters, a body, a class, an object, a
pattern, a type), so that the tokens inside are read for what they are. What it does not know it passes over: declarations are islands in the rest.
"""

from __future__ import annotations

from patchloom.operators.code_lex import Tokens
from patchloom.operators.code_tree import Import, Parsed, finished

BODIES = ("body", "block", "namespace", "")
#: Words that are no names.
JS_WORDS = frozenset((
    "if", "else", "for", "while", "do", "switch", "case", "default", "break", "continue", "return", "function", "class", "const", "let", "var", "new", "delete",
    "typeof", "instanceof", "in", "try", "catch", "finally", "throw", "import", "export", "async", "await", "yield", "extends", "super", "this", "with", "debugger",
    "null", "true", "false", "void", "undefined", "enum",
))
JAVA_WORDS = frozenset((
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue", "default", "do", "double", "else", "enum", "extends",
    "final", "finally", "float", "for", "goto", "if", "implements", "import", "instanceof", "int", "interface", "long", "native", "new", "package", "private",
    "protected", "public", "return", "short", "static", "strictfp", "super", "switch", "synchronized", "this", "throw", "throws", "transient", "try", "void", "volatile",
    "while", "null", "true", "false",
))
JAVA_MODIFIERS = frozenset((
    "public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "strictfp", "default", "sealed", "transient", "volatile",
))
GO_WORDS = frozenset((
    "break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if", "import", "interface", "map", "package",
    "range", "return", "select", "struct", "switch", "type", "var", "nil", "true", "false", "iota",
))
PHP_WORDS = frozenset((
    "abstract", "and", "array", "as", "break", "callable", "case", "catch", "class", "clone", "const", "continue", "declare", "default", "do", "echo", "else", "elseif",
    "empty", "enddeclare", "endfor", "endforeach", "endif", "endswitch", "endwhile", "enum", "extends", "final", "finally", "fn", "for", "foreach", "function", "global",
    "goto", "if", "implements", "include", "include_once", "instanceof", "insteadof", "interface", "isset", "list", "match", "namespace", "new", "or", "print",
    "private", "protected", "public", "readonly", "require", "require_once", "return", "static", "switch", "throw", "trait", "try", "unset", "use", "var", "while",
    "xor", "yield", "int", "string", "bool", "float", "void", "mixed", "null", "true", "false", "iterable", "never", "object",
))
TS_MODIFIERS = frozenset((
    "public", "private", "protected", "readonly", "override", "abstract", "declare", "accessor", "static", "async", "get", "set",
))


class Reader:
    """Tokens with roles of brackets, and what has been found."""

    words: frozenset[str] = frozenset()

    def __init__(self, t: Tokens):
        self.t, self.n = t, len(t)
        self.role: dict[int, str] = {}
        self.defined: set[int] = set()
        self.skipped: set[int] = set()
        self.scopes: list[tuple[str, str, int, int, int]] = []  # kind, name, first and last token, token whose line it starts on
        self.imports: list[Import] = []
        self._ends: dict[int, int] = {}

    def text(self, k: int) -> str:
        return self.t.text[k] if 0 <= k < self.n else ""

    def kind(self, k: int) -> str:
        return self.t.kind[k] if 0 <= k < self.n else ""

    def is_name(self, k: int) -> bool:
        return self.kind(k) == "id" and self.text(k) not in self.words

    def role_of(self, k: int) -> str:
        """The role of the bracket around a token; empty at the top."""
        up = self.t.up[k] if 0 <= k < self.n else -1
        return self.role.get(up, "other") if up >= 0 else ""

    def match(self, k: int) -> int:
        """The closing bracket; the last token where there is none."""
        found = self.t.match[k] if 0 <= k < self.n else -1
        return found if found >= 0 else self.n - 1

    def skip(self, a: int, b: int) -> None:
        """Names from ``a`` to before ``b`` are types or words, no uses."""
        self.skipped.update(range(a, min(b, self.n)))

    def scope(self, kind: str, name: str, first: int, last: int, line: int | None = None) -> None:
        self.scopes.append((kind, name, first, max(first, min(last, self.n - 1)), first if line is None else line))

    def value_end(self, k: int) -> int:
        """Whether a value may end with this token, so that a line break ends the statement."""
        return self.kind(k) in ("num", "str", "var", "attr") or self.text(k) in (")", "]", "}", "++", "--") or self.kind(k) == "id" and (self.is_name(k) or self.text(k) in ("this", "super", "null", "true", "false", "undefined", "break", "continue", "return"))

    def new_line(self, k: int) -> bool:
        return 0 < k < self.n and self.t.line[k - 1] < self.t.line[k]

    def expression_end(self, k: int, lines: bool) -> int:
        """The last token of the expression that begins at ``k``; with ``lines``, a line break may end it."""
        if k in self._ends:
            return self._ends[k]
        up, at, begun = self.t.up[k] if k < self.n else -1, k, [k]
        stop = self.t.match[up] if up >= 0 else -1
        while at < self.n:
            text = self.text(at)
            if text in (",", ";") or at == stop:
                break
            if at > k and lines and self.new_line(at) and self.value_end(at - 1) and (self.kind(at) != "op" or text in ("{", "<tag", "++", "--")) and text not in ("in", "instanceof", "of", "as"):
                break
            if text in ("=>", "->") and at > k:
                if at + 1 in self._ends:
                    at = self._ends[at + 1] + 1
                    break
                begun.append(at + 1)
            at = self.match(at) + 1 if self.t.match[at] > at else at + 1
        for b in begun:
            self._ends[b] = max(b, at - 1) if at - 1 >= b else b
        return self._ends[k]

    def parsed(self) -> Parsed:
        symbols = []
        for k in range(self.n):
            if self.kind(k) == "id" and k in self.defined:
                symbols.append((self.t.line[k], self.text(k), "definition"))
            elif self.is_name(k) and k not in self.skipped and self.is_use(k):
                symbols.append((self.t.line[k], self.text(k), "use"))
            elif self.kind(k) == "var" and k not in self.skipped:
                symbols += self.variable(k)
        return finished(self.t, self.scopes, self.imports, symbols)

    def is_use(self, k: int) -> bool:
        return self.text(k - 1) != "."

    def variable(self, k: int) -> list[tuple[int, str, str]]:
        return []


def _unquoted(text: str) -> str:
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'`" else text.strip("\"'`")


# --- JavaScript and TypeScript --------------------------------------------------------------------------------------------------------------


class Script(Reader):
    words = JS_WORDS

    def __init__(self, t: Tokens, types: bool):
        super().__init__(t)
        self.types = types
        self.value: dict[int, tuple[int, int]] = {}  # first token of a declarator's value: its name (or pattern) and its keyword
        self.listing: dict[int, int] = {}  # bracket (or -1) in which a declaration lists its names: its keyword
        self.opens: dict[int, int] = {}  # arrow to the bracket of its parameters

    # types

    def type_end(self, k: int) -> int:
        """After the type that begins at ``k``."""
        need, call = True, False  # call: what stands before can be the parameters of a function type
        while k < self.n:
            text = self.text(k)
            if need:
                call = text == "("
                if text in ("keyof", "typeof", "readonly", "unique", "infer", "asserts", "new", "abstract", "|", "&", "-", "..."):
                    k += 1
                    continue
                if text in ("(", "[", "{"):
                    self.mark(k, "type")
                    k = self.match(k) + 1
                elif text == "<":
                    k = self.generic_end(k)
                    continue
                elif self.kind(k) in ("id", "num", "str", "attr"):
                    k += 1
                    if self.text(k - 1) == "`" and self.text(k) == "${":
                        return k
                else:
                    return k
                need = False
            elif text == "<":
                k = self.generic_end(k)
            elif text == "[" and not self.new_line(k):
                k = self.match(k) + 1
            elif text in ("|", "&", ".", "is", "extends") or text == "=>" and call or text == "?" and self.text(k + 1) != ".":
                if text == "?" and not self._conditional(k):
                    return k
                k, need = k + 1, True
            elif text == ":" and self._conditional_else:
                self._conditional_else -= 1
                k, need = k + 1, True
            else:
                return k
        return k

    _conditional_else = 0

    def _conditional(self, k: int) -> bool:
        """A question mark in a type belongs to a conditional type."""
        back = k - 1
        while back > 0 and back > k - 40:
            if self.text(back) == "extends":
                self._conditional_else += 1
                return True
            if self.text(back) in (";", "{", ":", "="):
                return False
            back -= 1
        return False

    def mark(self, k: int, role: str) -> None:
        if self.role.setdefault(k, role) == "type":
            self.skip(k, self.match(k))

    def angle(self, k: int) -> int:
        """The end of ``<...>`` at ``k``; ``k`` where it isn't closed."""
        depth, at = 0, k
        while at < self.n and at < k + 400:
            text = self.text(at)
            if text == "<":
                depth += 1
            elif text == ">":
                depth -= 1
                if not depth:
                    return at
            elif text in ("(", "[", "{"):
                at = self.match(at)
            elif text in (";", ")", "]", "}"):
                break
            at += 1
        return k

    def generic_end(self, k: int) -> int:
        """After ``<...>`` at ``k``, whose names are types; ``k + 1`` where it isn't closed."""
        end = self.angle(k)
        self.skip(k, end)
        return end + 1

    def typed(self, k: int) -> int:
        """After the type annotation at ``k``, if there is one."""
        if self.types and self.text(k) in ("?", "!") and self.text(k + 1) == ":":
            k += 1
        if self.types and self.text(k) == ":":
            end = self.type_end(k + 1)
            self.skip(k + 1, end)
            return end
        return k

    # statements

    def starts(self, k: int) -> bool:
        """Whether a statement starts with the token."""
        p = k - 1
        if p < 0 or self.text(p) in (";", "else", "do"):
            return True
        if self.text(p) == "{":
            return self.role.get(p, "other") in BODIES
        if self.text(p) == "}":
            return self.role.get(self.t.match[p], "other") in (*BODIES, "class", "type", "clause") or self.new_line(k)
        if self.text(p) == ")":
            return self.role.get(self.t.match[p]) == "head" or self.new_line(k)
        if self.text(p) == ":":
            return self.role_of(p) in BODIES and not self.ternary(p)
        return self.new_line(k) and self.value_end(p)

    def ternary(self, k: int) -> bool:
        """Whether the colon at ``k`` belongs to a conditional expression; labels and cases have no question mark before it."""
        at = k - 1
        while at >= 0 and self.t.up[at] >= self.t.up[k]:
            if self.t.up[at] == self.t.up[k]:
                text = self.text(at)
                if text in ("case", "default", ";", "{"):
                    return False
                if text == "?":
                    return True
            at -= 1
        return False

    def declared(self, k: int, keyword: int) -> None:
        """A declarator begins at ``k``."""
        if self.text(k) in ("{", "["):
            self.role[k] = "pattern"
            after, name = self.typed(self.match(k) + 1), k
        elif self.kind(k) == "id":
            after, name = self.typed(k + 1), k
            if self.text(after) not in ("of", "in"):
                self.defined.add(k)
        else:
            return
        if self.text(after) == "=":
            self.value[after + 1] = (name, keyword)

    def body(self, close: int) -> int:
        """The brace of the body after parameters, or -1."""
        if self.text(close + 1) == "{":
            return close + 1
        if self.types and self.text(close + 1) == ":":
            end = self.type_end(close + 2)
            if self.text(end) == "{" or self.text(end) == "=>":
                self.skip(close + 2, end)
            if self.text(end) == "{":
                return end
        return -1

    def function(self, k: int) -> None:
        t, start = self.t, k - 1 if self.text(k - 1) == "async" and not self.new_line(k) else k
        at, generator, name = k + 1, False, -1
        if self.text(at) == "*":
            at, generator = at + 1, True
        if self.kind(at) == "id" and self.text(at) not in JS_WORDS:
            at, name = at + 1, at
        if self.text(at) == "<":
            at = self.generic_end(at)
        if self.text(at) != "(":
            return
        self.role[at] = "params"
        body = self.body(self.match(at))
        if body < 0:
            return
        self.role[body] = "body"
        exported = self.text(start - 1) in ("export", "default", "declare")
        declaration = name >= 0 and (exported or self.starts(start))
        if declaration:
            self.defined.add(name)
        if generator and not declaration:
            return
        bound, keyword = self.value.get(start, (-1, start))
        called = t.text[name] if name >= 0 else t.text[bound] if bound >= 0 and self.kind(bound) == "id" else "<anonymous>"
        self.scope("generator" if generator else "function", called, start, self.match(body), keyword if bound >= 0 else start)

    def klass(self, k: int) -> None:
        abstract = self.types and self.text(k - 1) == "abstract"
        named = self.kind(k + 1) == "id" and self.text(k + 1) not in ("extends", "implements")
        start = k - 1 if abstract else k
        declaration = named and not abstract and (self.text(start - 1) in ("export", "default", "declare") or self.starts(start))
        at, up = k + 1, self.t.up[k]
        while at < self.n and not (self.text(at) == "{" and self.t.up[at] == up):
            if self.text(at) == "<" and self.types:
                at = self.generic_end(at)
            elif self.text(at) in ("(", "["):
                self.role.setdefault(at, "args")
                at = self.match(at) + 1
            elif self.text(at) == "implements" and self.types:
                end = at
                while end < self.n and self.text(end) != "{":
                    end += 1
                self.skip(at, end)
                at = end
            elif self.text(at) == ";" or self.text(at) == "}":
                return
            else:
                at += 1
        if at >= self.n:
            return
        self.role[at] = "class"
        if named:
            (self.skipped if self.types else self.defined if declaration else set()).add(k + 1)
        if declaration:
            self.scope("class", self.text(k + 1), k, self.match(at))

    def key_start(self, k: int) -> int:
        """First token of a member's name and its modifiers."""
        if self.text(k) == "]":
            k = self.t.match[k] if self.t.match[k] >= 0 else k
        while self.t.up[k - 1] == self.t.up[k] and (self.text(k - 1) in TS_MODIFIERS or self.text(k - 1) == "*") and self.text(k - 2) not in (".", "="):
            k -= 1
        return k

    def member(self, k: int) -> bool:
        """A method whose parameters open at ``k``."""
        key = k - 1
        if self.types and self.text(key) == ">":
            while key > 0 and self.text(key) != "<" and key > k - 200:
                key -= 1
            key -= 1
        inside = self.role_of(k)
        if inside not in ("class", "object") or not (self.kind(key) in ("id", "str", "num") or self.text(key) == "]"):
            return False
        close = self.match(k)
        body = self.body(close)
        if body < 0:
            if inside == "class" and self.types and self.begins_member(self.key_start(key)):
                self.role[k] = "params"  # an overload or an abstract method
                self.skipped.add(key)
                self.typed(close + 1)
                return True
            return False
        start = self.key_start(key)
        if not self.begins_member(start):
            return False
        self.role[k], self.role[body] = "params", "body"
        self.skip(start, self.t.match[key] if self.text(key) == "]" else key + 1)
        name = "".join(self.t.text[self.t.match[key] : key + 1]) if self.text(key) == "]" else self.text(key)
        self.scope("method", name, start, self.match(body))
        return True

    def begins_member(self, k: int) -> bool:
        p = k - 1
        if self.t.up[k] == p:
            return True
        if self.role_of(k) == "object":
            return self.text(p) == ","
        return self.text(p) in (";", "}", ",") or self.new_line(k) or self.text(p).startswith("@") or self.text(p) == ")"

    def arrow(self, k: int) -> None:
        start = self.opens.get(k, k - 1)
        if self.text(k - 1) == ")" and k not in self.opens:
            start = self.t.match[k - 1]
        if start < 0:
            return
        if self.types and self.text(start - 1) == ">":
            back = start - 1
            while back > 0 and self.text(back) != "<" and back > start - 200:
                back -= 1
            self.skip(back, start)
            start = back
        if self.text(start - 1) == "async" and not self.new_line(start):
            start -= 1
        if self.text(k + 1) == "{":
            self.role[k + 1] = "body"
            end = self.match(k + 1)
        else:
            end = self.expression_end(k + 1, True)
        bound, keyword = self.value.get(start, (-1, start))
        name = self.text(bound) if bound >= 0 and self.kind(bound) == "id" else "<anonymous>"
        self.scope("arrow_function", name, start, end, keyword if bound >= 0 else start)

    def brace(self, k: int) -> str:
        """The role of a brace that nothing before has claimed."""
        p, before = k - 1, self.text(k - 1)
        if k in self.t.inserted:
            return "args"
        if p < 0 or before in (";", "else", "try", "finally", "do"):
            return "block"
        if before == "{":
            return "block" if self.role.get(p) in BODIES else "object"
        if before == "}":
            return "block"
        if before == ")":
            return "block"
        if before in ("import", "export") or before == "type" and self.text(p - 1) in ("import", "export") or self.role_of(k) == "" and before == "," and self.text(p - 2) in ("import", "type"):
            return "clause"
        if before == "static" and self.role_of(k) == "class":
            return "body"
        if before == ":" and self.role_of(p) in BODIES and not self.ternary(p):
            return "block"
        if self.role_of(k) in ("params", "pattern") and before in ("(", ",", "{", "[", "...", ":"):
            return "pattern"
        if self.kind(p) == "id" and self.is_name(p) and self.text(p - 1) in ("namespace", "module", "interface", "enum"):
            return "object"
        return "object" if not (self.new_line(k) and self.value_end(p)) else "block"

    def heading(self, k: int) -> bool:
        """namespace, module, interface, enum, type: claims their body or type."""
        word, at = self.text(k), k + 1
        if self.kind(at) not in ("id", "str") or self.new_line(at) or self.text(k - 1) in (".", "?."):
            return False
        if not (self.starts(k) or self.text(k - 1) in ("export", "declare", "default", "const")):
            return False
        if word in ("interface", "type"):
            self.skipped.update((k, at))
        else:
            self.skipped.add(k)
            self.defined.add(at)
        end = at + 1
        while self.text(end) == "." and self.kind(end + 1) == "id":
            end += 2
        if self.text(end) == "<":
            end = self.generic_end(end)
        if word == "type":
            if self.text(end) != "=":
                self.skipped.difference_update((k, at))
                return False
            self.defined.discard(at)
            stop = self.type_end(end + 1)
            self.skip(end, stop)
            return True
        begin = end
        while end < self.n and self.text(end) != "{":
            if self.text(end) in (";", "}", "=", ")"):
                return False
            end = self.generic_end(end) if self.text(end) == "<" else end + 1
        if end >= self.n:
            return False
        if word == "interface":
            self.skip(begin, end)
            self.mark(end, "type")
        elif word == "enum":
            self.role[end] = "object"
        else:
            self.role[end] = "namespace"
            if word == "namespace" or self.kind(at) == "id":
                self.scope("namespace", "".join(self.t.text[at:begin]), k, self.match(end))
        return True

    def import_clause(self, k: int) -> None:
        """``import`` at ``k``: a statement, or a call."""
        at = k + 1
        if self.text(at) == "(":
            self.module_call(k, at)
            return
        if self.text(at) == ".":
            return
        only_types = self.types and self.text(at) == "type" and self.text(at + 1) not in ("from", ",") and self.kind(at + 1) != "str"
        if only_types:
            self.skipped.add(at)
            at += 1
        names: list[str] | None = None
        aliases: list[tuple[str, str]] = []
        star = default = None
        while at < self.n and self.kind(at) != "str":
            text = self.text(at)
            if text == "{":
                self.role[at] = "clause"
                names, aliases = self.names(at)
                at = self.match(at)
            elif text == "*" and self.text(at + 1) == "as":
                star = self.text(at + 2)
                self.skipped.add(at + 1)
                at += 2
            elif text == "from":
                self.skipped.add(at)
            elif text == "=":  # import a = require("b")
                return
            elif self.kind(at) == "id":
                default = text
            elif text != ",":
                return
            at += 1
        if at >= self.n or only_types:
            return
        module = _unquoted(self.text(at))
        if default:
            names = [*(names or []), default]
        self.imports.append(Import(module, names, star, aliases, bool(star), _relative(module)))

    def names(self, k: int) -> tuple[list[str], list[tuple[str, str]]]:
        """Names and aliases of ``{ a, b as c, d: e, type F }``; types are left out."""
        names, aliases, part = [], [], []
        for at in range(k + 1, self.match(k) + 1):
            if self.text(at) == "," or at == self.match(k):
                word = [self.text(p) for p in part]
                if self.types and len(word) > 1 and word[0] == "type" and word[1] != "as":
                    self.skipped.add(part[0])
                    word = []
                if word:
                    names.append(_unquoted(word[0]))
                if len(word) > 2 and word[1] in ("as", ":"):
                    self.skipped.add(part[1])
                    aliases.append((_unquoted(word[0]), word[2]))
                part = []
            elif self.t.up[at] == k:
                part.append(at)
        return names, aliases

    def module_call(self, k: int, opening: int) -> None:
        """``require("x")`` or ``import("x")``, alone or as the value of a declaration."""
        if self.kind(opening + 1) != "str" or self.match(opening) != opening + 2:
            return
        first = k - 1 if self.text(k - 1) == "await" else k
        module, (bound, keyword) = _unquoted(self.text(opening + 1)), self.value.get(first, (-1, -1))
        if bound >= 0 and self.text(opening + 3) not in (".", "(", "[", "?."):
            if self.text(bound) == "{":
                names, aliases = self.names(bound)
                self.imports.append(Import(module, names, None, aliases, False, _relative(module)))
            else:
                self.imports.append(Import(module, None, self.text(bound), [], False, _relative(module)))
        elif self.text(k) == "import" or self.starts(first):
            self.imports.append(Import(module, None, None, [], False, _relative(module)))

    def read(self) -> Parsed:
        t = self.t
        for k in range(self.n):
            text, kind = t.text[k], t.kind[k]
            free = text not in ("", ".") and self.text(k - 1) not in (".", "?.")
            if kind == "id" and free:
                key = self.text(k + 1) == ":" and self.role_of(k) in ("object", "pattern", "type")
                if text == "function" and not key:
                    self.function(k)
                elif text in ("const", "let", "var") and (self.kind(k + 1) == "id" or self.text(k + 1) in ("{", "[")) and self.text(k + 1) not in ("enum", "in", "of"):
                    self.listing[t.up[k]] = k
                    self.declared(k + 1, k)
                elif text == "class" and not key and (self.kind(k + 1) == "id" or self.text(k + 1) == "{"):
                    self.klass(k)
                elif text == "import" and self.role_of(k) not in ("object", "class"):
                    self.import_clause(k)
                elif text == "require" and self.text(k + 1) == "(":
                    self.module_call(k, k + 1)
                elif self.types and text in ("namespace", "module", "interface", "type", "enum") and self.heading(k):
                    pass
                elif self.types and text in ("as", "satisfies") and self.value_end(k - 1) and not self.new_line(k) and self.role_of(k) != "clause":
                    self.skip(k, self.type_end(k + 1))
                elif self.role_of(k) == "class" and self.begins_member(self.key_start(k)) and self.text(k + 1) != "(" and not text.startswith("@"):
                    self.skipped.add(k)
                    if text not in TS_MODIFIERS or self.text(k + 1) in ("=", ":", ";", "?", "!"):
                        self.typed(k + 1)
            elif kind == "op":
                if text == ";":
                    self.listing.pop(t.up[k], None)
                elif text == "," and t.up[k] in self.listing and self.role_of(k) in (*BODIES, "head"):
                    self.declared(k + 1, self.listing[t.up[k]])
                elif text == "(":
                    self.parenthesis(k)
                elif text == "{":
                    self.role.setdefault(k, self.brace(k))
                elif text == "[" and self.role_of(k) in ("params", "pattern"):
                    self.role.setdefault(k, "pattern")
                elif text == "=>" and self.role_of(k) != "type" and k not in self.skipped:
                    self.arrow(k)
                elif text == "<" and self.types and kind == "op" and self.kind(k - 1) == "id":
                    self.arguments_of_type(k)
            if self.role_of(k) == "params":
                self.parameter(k)
            if kind == "id" and text not in JS_WORDS and self.text(k + 1) == "=" and free and k not in self.skipped and self.role_of(k) not in ("params", "pattern", "class", "object", "type"):
                self.defined.add(k)
        self.hide_in_declarations()
        return self.parsed()

    def arguments_of_type(self, k: int) -> None:
        """``f<T>(...)`` and ``new A<T>()``: what stands between is a type."""
        end = self.angle(k)
        if end > k and self.text(end + 1) in ("(", "`") and not any(x in ("=", "+", "-", "*", "!", "&&", "||", "==", "===", "!=", "!==") for x in self.t.text[k:end]):
            self.skip(k, end)

    def parenthesis(self, k: int) -> None:
        if k in self.role:
            return
        before, close = self.text(k - 1), self.match(k)
        if before in ("if", "while", "for", "with", "switch", "catch", "await") and self.kind(k - 1) == "id" and self.text(k - 2) not in (".", "?.") and not (self.role_of(k) in ("class", "object") and self.body(close) > 0):
            self.role[k] = "head"
        elif self.member(k):
            pass
        elif self.text(close + 1) == "=>":
            self.role[k] = "params"
        elif self.types and self.text(close + 1) == ":" and self.t.match[k] > k and self.text(end := self.type_end(close + 2)) == "=>":
            self.role[k] = "params"
            self.opens[end] = k
            self.skip(close + 2, end)
        else:
            self.role[k] = "args"

    def parameter(self, k: int) -> None:
        """A name or a type among parameters."""
        if self.kind(k) == "id" and self.text(k) not in JS_WORDS:
            opening = self.t.up[k]
            first = k
            while self.types and self.text(first - 1) in TS_MODIFIERS and first - 1 > opening:
                self.skipped.add(first - 1)
                first -= 1
            if self.text(first - 1) in ("(", ",") or self.text(first - 1).startswith("@"):
                after = self.text(k + 1)
                if after in (",", ")") or self.types and after in ("=", ":", "?"):
                    self.defined.add(k)
                self.typed(k + 1)
            elif self.text(first - 1) == "...":
                self.typed(k + 1)
        elif self.text(k) in ("}", "]") and self.t.match[k] >= 0:
            self.typed(k + 1)

    def hide_in_declarations(self) -> None:
        """In JavaScript, a declaration shows the first function that is a value of its own, and else none of the scopes inside it."""
        if self.types:
            return
        spans: dict[int, list[tuple[int, int]]] = {}
        for first, (_, keyword) in self.value.items():
            spans.setdefault(keyword, []).append((first, self.expression_end(first, True)))
        own = {(s[2]): s for s in self.scopes}
        hidden = []
        for values in spans.values():
            shown = next((own[a] for a, _ in values if a in own), None)
            for a, b in values:
                if shown is None or a != shown[2]:
                    hidden.append((a, b))
        hidden.sort()
        merged: list[list[int]] = []
        for a, b in hidden:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        at, kept = 0, []
        for s in sorted(self.scopes, key=lambda s: s[2]):
            while at < len(merged) and merged[at][1] < s[2]:
                at += 1
            if not (at < len(merged) and merged[at][0] <= s[2]):
                kept.append(s)
        self.scopes = kept

    def is_use(self, k: int) -> bool:
        before, after, inside = self.text(k - 1), self.text(k + 1), self.role_of(k)
        if before in (".", "?.") or inside == "type" or after == ":" and inside in BODIES and self.starts(k):
            return False
        if inside in ("object", "pattern"):
            if after == ":" and before in ("{", ",", "get", "set", "async", "static"):
                return False
            if before in ("{", ",") and after in (",", "}", "=") and self.t.up[k] >= 0 and self.text(self.t.up[k]) == "{":
                return False
        if self.text(k) in ("of", "get", "set", "static", "async", "from", "as") and (self.kind(k + 1) == "id" or after in ("(", "[", "{", "*")) and self.kind(k - 1) in ("id", "op") and before not in ("=", "(", ",", "return"):
            return False
        if self.types and self.text(k) in ("declare", "abstract", "global") and (self.kind(k + 1) == "id" or after == "{") and not self.new_line(k + 1):
            return False
        return not (self.text(k) == "async" and after in ("function", "("))


def _relative(module: str) -> bool:
    return module.startswith(("./", "../")) or module in (".", "..")


# --- Java ---------------------------------------------------------------------------------------------------------------------------------


class Java(Reader):
    words = JAVA_WORDS
    HOMES = ("class", "interface", "enum", "record", "annotation")

    def back_over_modifiers(self, k: int) -> int:
        """The first token of the modifiers and annotations before ``k``."""
        while k > 0:
            p = k - 1
            if self.text(p) in JAVA_MODIFIERS or self.text(p) == "sealed" or self.text(p) == "-" and self.text(p - 1) == "non":
                k = p
            elif self.kind(p) == "id" and self.text(p - 1) == "@":
                k = p - 1
            elif self.kind(p) == "id" and self.text(p - 1) == "." and self.kind(p - 2) == "id":
                at = p
                while self.text(at - 1) == ".":
                    at -= 2
                if self.text(at - 1) != "@":
                    return k
                k = at - 1
            elif self.text(p) == ")" and self.t.match[p] > 0:
                at = self.t.match[p] - 1
                while self.text(at - 1) == ".":
                    at -= 2
                if self.text(at - 1) != "@" or self.kind(at) != "id":
                    return k
                self.role[self.t.match[p]] = "args"
                k = at - 1
            else:
                return k
        return k

    def type_end(self, k: int) -> int:
        """After the type that begins at ``k``; ``k`` where none does."""
        at = k
        while self.text(at) == "@" and self.kind(at + 1) == "id":
            at += 2
        if self.text(at) == "?":
            at += 1
            if self.text(at) not in ("extends", "super"):
                return at
            at += 1
        if self.kind(at) != "id" or self.text(at) in JAVA_WORDS and self.text(at) not in ("int", "long", "double", "float", "boolean", "byte", "short", "char", "void"):
            return k
        at += 1
        while True:
            if self.text(at) == "<":
                end = self.generic_end(at)
                if end < 0:
                    return at
                at = end
            elif self.text(at) == "." and self.kind(at + 1) == "id" and self.text(at + 1) not in JAVA_WORDS:
                at += 2
            elif self.text(at) == "[" and self.text(at + 1) == "]":
                at += 2
            elif self.text(at) == "&" and self.kind(at + 1) == "id":
                at += 2
            else:
                return at

    def generic_end(self, k: int) -> int:
        """After ``<...>`` with types alone inside; -1 where it is a comparison."""
        depth, at = 0, k
        while at < min(self.n, k + 300):
            text = self.text(at)
            if text == "<":
                depth += 1
            elif text == ">":
                depth -= 1
                if not depth:
                    return at + 1
            elif not (self.kind(at) == "id" or text in (",", "?", ".", "[", "]", "&", "@")):
                return -1
            at += 1
        return -1

    def declares(self, k: int) -> int:
        """Where a type and a name stand at ``k``, the place of the name; else -1."""
        end = self.type_end(k)
        if end > k and self.text(end) == "...":
            end += 1
        return end if end > k and self.is_name(end) and self.text(end - 1) not in (".", "@") else -1

    def heading(self, k: int) -> None:
        """class, interface, enum, record, @interface."""
        word = self.text(k)
        if word == "record" and not (self.is_name(k + 1) and self.text(k + 2) in ("(", "<")):
            return
        annotation = self.text(k - 1) == "@"
        at = k + 2
        if not self.is_name(k + 1):
            return
        (self.skipped if word == "record" or annotation else self.defined).add(k + 1)
        self.skipped.add(k)
        while at < self.n and self.text(at) != "{":
            if self.text(at) == "(":
                self.role[at] = "params"
                self.parameters(at)
                at = self.match(at)
            elif self.text(at) in (";", "}", ")"):
                return
            else:
                self.skipped.add(at)
            at += 1
        if at >= self.n:
            return
        self.role[at] = "annotation" if annotation else word
        if word != "record" and not annotation:
            self.scope(word, self.text(k + 1), self.back_over_modifiers(k), self.match(at))

    def parameters(self, k: int) -> None:
        at, end = k + 1, self.match(k)
        while at < end:
            while self.text(at) == "final" or self.text(at) == "@":
                at += 1 if self.text(at) == "final" else 2
                if self.text(at) == "(" and self.text(at - 2) == "@":
                    at = self.match(at) + 1
            name = self.declares(at)
            if name >= 0:
                self.skip(at, name)
                self.defined.add(name)
                at = name
            elif self.is_name(at) and self.text(at + 1) in (",", ")"):
                self.defined.add(at)  # the parameters of a lambda
            while at < end and self.text(at) != ",":
                at = self.match(at) + 1 if self.t.match[at] > at else at + 1
            at += 1

    def method(self, k: int) -> bool:
        """A method or constructor whose parameters open at ``k``."""
        home = self.role_of(k)
        if home not in self.HOMES or not self.is_name(k - 1):
            return False
        name, up = k - 1, self.t.up[k]
        first = name
        while first - 1 > up:
            p = first - 1
            if self.text(p) in (";", "=", ",", "->", "::") and self.t.up[p] == up:
                if self.text(p) in ("=", ",", "->", "::"):
                    if self.text(p) == "," and home == "enum" and first == name:
                        break
                    if not self.generic_comma(p, name):
                        return False
                else:
                    break
            if self.text(p) == "}" and self.t.up[p] == up:
                break
            first = self.t.match[p] if self.text(p) in (")", "]") and self.t.match[p] >= 0 else p
        if home == "enum" and first == name and up not in self.members:
            self.role[k] = "args"
            self.defined.add(name)
            if self.text(self.match(k) + 1) == "{":
                self.role[self.match(k) + 1] = "class"
            return True
        head = first
        while head < name and (self.text(head) in JAVA_MODIFIERS or self.text(head) == "@"):
            if self.text(head) == "@":
                head += 2
                while self.text(head) == ".":
                    head += 2
                if self.text(head) == "(":
                    self.role[head] = "args"
                    head = self.match(head) + 1
            else:
                head += 1
        if self.text(head) == "<":
            head = max(head, self.generic_end(head))
        typed = self.type_end(head)
        if head < name and typed != name:
            return False
        close = self.match(k)
        body = close + 1
        while body < self.n and (self.text(body) in ("throws", ".", ",", "[", "]", "@", "default") or self.kind(body) in ("id", "str", "num")) and self.text(body) not in (";", "{"):
            body += 1
        if self.text(body) not in ("{", ";"):
            return False
        self.skip(first, name)
        self.skip(close + 1, body)
        self.role[k] = "params"
        self.defined.add(name)
        self.parameters(k)
        if self.text(body) == "{":
            self.role[body] = "body"
        kind = "constructor" if head == name else "method"
        if kind == "method" or self.text(body) == "{":
            self.scope(kind, self.text(name), first, self.match(body) if self.text(body) == "{" else body)
        return True

    def generic_comma(self, k: int, name: int) -> bool:
        """Whether a comma before a method's name stands in the type of its result."""
        at = k
        while at > 0 and self.text(at) not in (";", "{", "}", "=", "("):
            if self.text(at) == "<":
                return self.generic_end(at) > k
            at -= 1
        return False

    def is_lambda(self, k: int) -> bool:
        """An arrow that isn't one of a switch."""
        up = self.t.up[k]
        if up < 0 or self.text(up) != "{" or self.role.get(up) != "block":
            return True
        at = k - 1
        while at > up and not (self.t.up[at] == up and self.text(at) in (";", "->", "=", "return", "}")):
            if self.t.up[at] == up and self.text(at) in ("case", "default"):
                return False
            at -= 1
        return True

    def read(self) -> Parsed:
        t = self.t
        listing: dict[int, bool] = {}
        k = 0
        while k < self.n:
            text, kind = t.text[k], t.kind[k]
            before = self.text(k - 1)
            if kind == "id" and text in ("import", "package") and self.role_of(k) == "" and before in ("", ";", "}"):
                k = self.import_(k)
                continue
            if kind == "id" and before != ".":
                if text in ("class", "interface", "enum", "record"):
                    self.heading(k)
                elif text == "new":
                    end = self.type_end(k + 1)
                    self.skip(k + 1, end)
                    if self.text(end) == "(" and self.text(self.match(end) + 1) == "{":
                        self.role[self.match(end) + 1] = "class"
                elif text == "instanceof":
                    self.skip(k + 1, self.type_end(k + 1))
                elif text in ("extends", "super") and before == "?":
                    pass
                elif before == "@":
                    end = k + 1
                    while self.text(end) == ".":
                        end += 2
                    self.skip(k, end)
                elif k not in self.skipped and k not in self.defined and (name := self.declares(k)) >= 0 and text not in ("return", "throw", "else", "case", "yield"):
                    self.skip(k, name)
                    after = self.text(name + 1)
                    if after in ("=", ";", ",") or after == "[":
                        self.defined.add(name)
                        listing[t.up[k]] = True
                    elif after == ")" and self.text(t.up[k] - 1) == "catch":
                        self.defined.add(name)
                elif text == "catch" and self.text(k + 1) == "(":
                    close = self.match(k + 1)
                    if self.is_name(close - 1):
                        self.skip(k + 2, close - 1)
                        self.defined.add(close - 1)
                elif self.text(k + 1) == "." and self.text(k + 2) == "class":
                    self.skipped.add(k)
                elif self.role_of(k) == "enum" and before in ("{", ",", "}") and self.text(k + 1) in (",", ";", "}", "{") and self.is_name(k):
                    self.defined.add(k)
                    if self.text(k + 1) == "{":
                        self.role[k + 1] = "class"
            elif kind == "op":
                if text == ";":
                    listing.pop(t.up[k], None)
                    self.members.add(t.up[k])
                elif text == "," and listing.get(t.up[k]) and self.is_name(k + 1) and self.text(k + 2) in ("=", ",", ";", "["):
                    self.defined.add(k + 1)
                elif text == "(" and k not in self.role and not self.method(k):
                    self.role[k] = "args"
                    self.cast(k)
                elif text == "{" and k not in self.role:
                    self.role[k] = "block"
                elif text == "->" and self.is_lambda(k):
                    self.lambda_(k)
                elif text == "<" and self.kind(k - 1) != "id" and before == "." and (end := self.generic_end(k)) > 0:
                    self.skip(k, end)
            k += 1
        return self.parsed()

    def import_(self, k: int) -> int:
        end = k
        while end < self.n and self.text(end) != ";":
            end += 1
        words = [self.text(x) for x in range(k + 1, end)]
        static = words[:1] == ["static"]
        words = words[static:]
        self.skip(k + 1, end)  # the parts of a path are no uses of values
        if self.text(k) == "import" and words:
            name = "".join(words)
            if name.endswith(".*"):
                self.imports.append(Import(name[:-2], [], is_star=True))
            elif static:
                self.imports.append(Import(name.rpartition(".")[0], [name.rpartition(".")[2]]))
            else:
                self.imports.append(Import(name, [name.rpartition(".")[2]]))
        return end + 1

    def __init__(self, t: Tokens):
        super().__init__(t)
        self.members: set[int] = set()  # enums whose constants are over

    def cast(self, k: int) -> None:
        end = self.type_end(k + 1)
        if end == self.match(k) and end > k + 1 and self.text(k + 1)[:1].isupper() and self.text(k - 1) not in ("if", "while", "switch", "for", "catch", "synchronized") and not self.is_name(k - 1):
            after = end + 1
            if self.kind(after) in ("id", "str", "num") and not self.new_line(after) and self.text(after) != "instanceof" or self.text(after) == "(":
                self.skip(k + 1, end)

    def lambda_(self, k: int) -> None:
        start = k - 1
        if self.text(start) == ")" and self.t.match[start] >= 0:
            start = self.t.match[start]
            self.role[start] = "params"
            self.parameters(start)
        elif self.is_name(start):
            self.defined.add(start)
        else:
            return
        if self.text(k + 1) == "{":
            self.role[k + 1] = "body"
            end = self.match(k + 1)
        else:
            end = self.expression_end(k + 1, False)
        self.scope("lambda", "<lambda>", start, end)

    def is_use(self, k: int) -> bool:
        if self.text(k) == "yield" and self.text(k + 1) not in (".", "(", "=", ")", ",", ";"):
            return False
        return self.text(k - 1) != "." and not (self.text(k) in ("var", "record", "sealed", "permits") and self.kind(k + 1) == "id")


# --- Go -----------------------------------------------------------------------------------------------------------------------------------


class Go(Reader):
    words = GO_WORDS

    def type_end(self, k: int) -> int:
        """After the type that begins at ``k``; ``k`` where none does."""
        text = self.text(k)
        if text in ("*", "<-", "chan", "...", "~"):
            return self.type_end(k + 1)
        if text == "[":
            return self.type_end(self.match(k) + 1)
        if text == "map" and self.text(k + 1) == "[":
            return self.type_end(self.match(k + 1) + 1)
        if text in ("struct", "interface") and self.text(k + 1) == "{":
            self.role[k + 1] = "type"
            return self.match(k + 1) + 1
        if text == "func" and self.text(k + 1) == "(":
            end = self.match(k + 1) + 1
            return self.match(end) + 1 if self.text(end) == "(" else self.type_end(end) if not self.new_line(end) else end
        if text == "(":
            return self.match(k) + 1
        if self.is_name(k):
            k += 1
            while self.text(k) == "." and self.kind(k + 1) == "id":
                k += 2
            if self.text(k) == "[" and not self.t.space[k] and self.text(k + 1) != "]":
                k = self.match(k) + 1
            return k
        return k

    def parameters(self, k: int) -> None:
        """Names and types between parentheses: all have names, or none."""
        end, at, parts = self.match(k), k + 1, []
        while at < end:
            first = at
            while at < end and self.text(at) != ",":
                at = self.match(at) + 1 if self.t.match[at] > at else at + 1
            parts.append((first, at))
            at += 1
        named = any(self.is_name(a) and b > a + 1 and self.text(a + 1) not in (".", "[") or self.is_name(a) and self.text(a + 1) == "[" and self.t.space[a + 1] for a, b in parts)
        fresh = True
        for a, b in parts:
            if not named:
                self.skip(a, b)
                continue
            if self.is_name(a) and fresh:
                self.defined.add(a)  # of several names with one type, the first
            fresh = b > a + 1
            if b > a + 1:
                self.type_end(a + 1)
                self.skip(a + 1, b)

    def function(self, k: int) -> None:
        top = self.t.up[k] < 0 and (k == 0 or self.new_line(k) or self.text(k - 1) == ";")
        at, name, kind = k + 1, -1, "function"
        if top and self.text(at) == "(" and self.is_name(self.match(at) + 1) and not self.new_line(self.match(at) + 1):
            self.parameters(at)
            at, kind = self.match(at) + 1, "method"
            name = at
            self.skipped.add(name)
        elif top and self.is_name(at):
            name = at
            self.defined.add(name)
        if name >= 0:
            at = name + 1
            if self.text(at) == "[":
                self.skip(at, self.match(at))
                at = self.match(at) + 1
        if self.text(at) != "(":
            return
        self.role[at] = "params"
        self.parameters(at)
        end = self.match(at) + 1
        if self.text(end) == "(" and not self.new_line(end):
            self.parameters(end)
            end = self.match(end) + 1
        elif not self.new_line(end) and self.text(end) != "{":
            after = self.type_end(end)
            self.skip(end, after)
            end = after
        if self.text(end) == "{" and not self.new_line(end):
            self.role[end] = "body"
            self.scope(kind, self.text(name) if name >= 0 else "<anonymous>", k, self.match(end))
        elif name >= 0 and top:
            self.scope(kind, self.text(name), k, end - 1)  # a body written elsewhere

    def left_of(self, k: int) -> None:
        """Names of the list before ``:=`` or ``range``."""
        at, up = k - 1, self.t.up[k]
        while at > up and not (self.t.up[at] == up and self.text(at) in (";", "{", "}", "for", "if", "switch", "case", "select", ":", "else", "go", "defer", "(")):
            if self.t.up[at] == up and self.new_line(at + 1) and self.text(at) != ",":
                break
            if self.is_name(at):
                self.defined.add(at)
            at -= 1

    def spec(self, k: int) -> None:
        """One entry of var, const or type."""
        if not self.is_name(k):
            return
        word = self.kind_of_spec
        if word == "type":
            self.skipped.add(k)
            at = k + 1
            if self.text(at) == "[" and self.is_name(at + 1) and self.text(at + 2) not in ("]",):
                self.skip(at, self.match(at))
                at = self.match(at) + 1
            if self.text(at) == "=":
                at += 1
            end = self.type_end(at)
            self.skip(at, end)
            return
        self.defined.add(k)
        at = k + 1
        while self.text(at) == "," and self.is_name(at + 1):
            at += 2
        if self.text(at) not in ("=", ")", ";", "") and not self.new_line(at):
            self.skip(at, self.type_end(at))

    kind_of_spec = ""

    def read(self) -> Parsed:
        t, head = self.t, {}
        for k in range(self.n):
            text, kind, before = t.text[k], t.kind[k], self.text(k - 1)
            up = t.up[k]
            if kind == "id" and before != ".":
                if text == "func":
                    self.function(k)
                elif text in ("if", "for", "switch", "select"):
                    head[up] = True
                elif text in ("var", "const", "type", "import"):
                    self.kind_of_spec = text
                    if self.text(k + 1) == "(":
                        self.role[k + 1] = "specs"
                        if text != "import":
                            for x in range(k + 2, self.match(k + 1)):
                                if t.up[x] == k + 1 and (x == k + 2 or self.new_line(x) or self.text(x - 1) == ";"):
                                    self.spec(x)
                        else:
                            self.import_(k + 2, self.match(k + 1))
                    elif text == "import":
                        end = k + 1
                        while end < self.n and not self.new_line(end) and self.text(end) != ";":
                            end += 1
                        self.import_(k + 1, end)
                    else:
                        self.spec(k + 1)
                elif text == "package":
                    self.skipped.add(k + 1)
                elif text == "range":
                    if before in (":=", "="):
                        self.left_of(k - 1)
                elif text in ("map", "chan", "struct", "interface") and k not in self.skipped:
                    self.skip(k, self.type_end(k))
                elif text in ("goto", "break", "continue") and self.is_name(k + 1) and not self.new_line(k + 1):
                    self.skipped.add(k + 1)
                elif self.is_name(k) and self.text(k + 1) == ":" and self.role.get(up) in ("body", "block") and (self.new_line(k) or before in ("{", ";")):
                    self.skipped.add(k)  # a label
            elif text == ":=":
                self.left_of(k)
            elif text == "(" and before == ".":
                self.skip(k, self.match(k))  # x.(T)
            elif text == "]" and t.match[k] >= 0 and not self.new_line(k + 1) and (self.is_name(k + 1) and not t.space[k + 1] or self.text(k + 1) in ("*", "[") and self.text(t.match[k] + 1) == "]"):
                self.skip(k + 1, self.type_end(k + 1))  # []T, [3]T
            elif text == "{" and k not in self.role:
                if head.get(up):
                    head[up] = False
                    self.role[k] = "block"
                elif before == "else" or before in ("", ";", ":") or self.new_line(k) and before != ",":
                    self.role[k] = "block" if self.role.get(up) != "literal" else "literal"
                else:
                    self.role[k] = "literal"
                    at = k - 1
                    if self.text(at) == "]" and t.match[at] > 0 and self.is_name(t.match[at] - 1):
                        self.skip(t.match[at], at)
                        at = t.match[at] - 1
                    if self.kind(at) == "id":
                        self.skipped.add(at)
                        if self.text(at - 1) == ".":
                            self.skipped.add(at - 2)
        return self.parsed()

    def import_(self, k: int, end: int) -> None:
        for x in range(k, end):
            if self.kind(x) == "str" and self.text(x)[:1] in ('"', "`"):
                alias = self.text(x - 1) if x > k and self.t.line[x - 1] == self.t.line[x] and (self.kind(x - 1) == "id" or self.text(x - 1) == ".") else None
                if alias:
                    self.skipped.add(x - 1)
                self.imports.append(Import(_unquoted(self.text(x)), None, alias, is_star=alias == "."))


# --- PHP ----------------------------------------------------------------------------------------------------------------------------------


class Php(Reader):
    words = PHP_WORDS
    HOMES = ("class", "trait", "interface", "enum")

    def is_name(self, k: int) -> bool:
        return self.kind(k) == "id" and self.text(k).lower() not in self.words

    def word(self, k: int) -> str:
        """A keyword in small letters; not where it names a member."""
        return self.text(k).lower() if self.kind(k) == "id" and self.text(k - 1) not in ("->", "?->", "::") else ""

    def modifiers(self, k: int) -> int:
        while self.word(k - 1) in ("public", "private", "protected", "static", "final", "abstract", "readonly", "var"):
            k -= 1
        while self.text(k - 1) == "]" and self.t.match[k - 1] >= 0 and self.role.get(self.t.match[k - 1]) == "attribute":
            k = self.t.match[k - 1]
        return k

    def type_back(self, k: int) -> None:
        """Names of the type that ends before ``k``."""
        at = k - 1
        while self.kind(at) == "id" or self.text(at) in ("\\", "|", "?", "&", "(", ")") and self.kind(at - 1) in ("id", "op") and self.text(at) != "(" and self.text(at) != ")":
            if self.kind(at) == "id" and self.word(at) in ("public", "private", "protected", "static", "readonly", "var"):
                break
            self.skipped.add(at)
            at -= 1

    def result(self, k: int) -> int:
        """After the type of a result at ``k``, if there is one."""
        if self.text(k) != ":":
            return k
        k += 1
        first = k
        while k < self.n and (self.kind(k) == "id" or self.text(k) in ("\\", "|", "?", "&", "(", ")")):
            k = k + 1
        self.skip(first, k)
        return k

    def function(self, k: int) -> None:
        at = k + 1 + (self.text(k + 1) == "&")
        name = at if self.kind(at) == "id" and self.text(at + 1) == "(" else -1
        at = at + 1 if name >= 0 else at
        if self.text(at) != "(":
            return
        self.role[at] = "params"
        end = self.match(at) + 1
        if self.word(end) == "use" and self.text(end + 1) == "(":
            end = self.match(end + 1) + 1
        end = self.result(end)
        start = self.modifiers(k)
        home = self.role_of(k) in self.HOMES
        if name >= 0:
            self.defined.add(name)
            self.skipped.discard(name)
        if self.text(end) == "{":
            self.role[end] = "body"
            last = self.match(end)
        elif self.text(end) == ";" and name >= 0:
            last = end
        else:
            return
        self.scope("method" if name >= 0 and home else "function" if name >= 0 else "closure", self.text(name) if name >= 0 else "<anonymous>", start, last)

    def heading(self, k: int) -> None:
        word = self.word(k)
        named = self.is_name(k + 1) and self.text(k + 1) not in ("extends", "implements")
        at, up = k + 1, self.t.up[k]
        while at < self.n and not (self.text(at) == "{" and self.t.up[at] == up):
            if self.text(at) in (";", "}"):
                return
            if self.word(at) in ("extends", "implements"):
                end = at
                while end < self.n and self.text(end) != "{":
                    end += 1
                self.skip(at, end)
            at += 1
        if at >= self.n:
            return
        self.role[at] = word
        if named and self.text(k - 1) != "new":
            if word != "enum":
                self.defined.add(k + 1)
                self.scope(word, self.text(k + 1), self.modifiers(k), self.match(at))

    def read(self) -> Parsed:
        t = self.t
        for k in range(self.n):
            text, kind, before = t.text[k], t.kind[k], self.text(k - 1)
            word = self.word(k)
            if word in ("class", "trait", "interface", "enum") and (self.kind(k + 1) == "id" or before == "new"):
                self.heading(k)
            elif word == "function":
                if self.word(k - 1) != "use":
                    self.function(k)
            elif word == "fn" and (self.text(k + 1) == "(" or self.text(k + 1) == "&"):
                at = k + 1 + (self.text(k + 1) == "&")
                self.role[at] = "params"
                arrow = self.result(self.match(at) + 1)
                if self.text(arrow) == "=>":
                    self.scope("arrow_function", "<anonymous>", k - 1 if self.word(k - 1) == "static" else k, self.expression_end(arrow + 1, False))
            elif word == "use" and self.role_of(k) in ("", "namespace") and before in ("", ";", "}", "{"):
                self.use(k)
            elif word in ("require", "require_once", "include", "include_once"):
                self.include(k)
            elif word == "namespace" and before in ("", ";", "}"):
                end = k + 1
                while self.kind(end) == "id" or self.text(end) == "\\":
                    end += 1
                if self.text(end) == "{":
                    self.role[end] = "namespace"
            elif word == "catch" and self.text(k + 1) == "(":
                self.skip(k + 2, self.match(k + 1))
                self.skipped -= {x for x in range(k + 2, self.match(k + 1)) if t.kind[x] == "var"}
            elif kind == "var" and (self.role_of(k) == "params" or self.role_of(k) in self.HOMES and before not in (",", "=", "=>", "[", "(")):
                at = k
                while self.text(at - 1) in ("&", "..."):
                    at -= 1
                self.type_back(at)
            elif text == "[" and before in ("", ";", "}", "{", "]") and t.source.startswith("#[", t._starts[t.line[k] - 1] if t.line[k] else 0) or text == "[" and self.attribute(k):
                self.role[k] = "attribute"
            elif text == "{" and k not in self.role:
                self.role[k] = "block"
            elif text == "(" and k not in self.role:
                self.role[k] = "args"
        return self.parsed()

    def attribute(self, k: int) -> bool:
        """``#[`` is kept as a bracket that begins a declaration, a parameter or a member."""
        after = self.match(k) + 1
        return self.kind(k + 1) == "id" and self.text(k + 1)[:1].isupper() and self.word(after) in ("class", "function", "public", "private", "protected", "final", "abstract", "readonly", "static", "interface", "trait", "enum", "fn")

    def use(self, k: int) -> None:
        end = k + 1
        while end < self.n and self.text(end) != ";":
            end += 1
        at, prefix = k + 1, ""
        kinds = ("function", "const")
        if self.word(at) in kinds:
            at += 1
        words: list[str] = []
        alias = None
        for x in range(at, end + 1):
            text = self.text(x)
            if text == "{":
                prefix, words = "".join(words), []
            elif text in (",", "}") or x == end:
                if words:
                    name, last = "".join(words), "".join(words).rpartition("\\")[2]
                    self.imports.append(Import((prefix + name).lstrip("\\"), [last], alias, [(last, alias)] if alias else []))
                words, alias = [], None
            elif self.word(x) == "as":
                alias = self.text(x + 1)
                self.skipped.add(x + 1)
            elif self.word(x - 1) != "as" and not (self.word(x) in kinds and self.text(x - 1) in ("{", ",")):
                words.append(text)

    def include(self, k: int) -> None:
        at = k + 1 + (self.text(k + 1) == "(")
        here = self.text(at).upper() == "__DIR__" or self.text(at) == "dirname"
        while at < self.n and self.kind(at) != "str" and self.text(at) not in (";", "}", "="):
            at += 1
        if self.kind(at) == "str" and len(self.text(at)) > 2 and self.text(at)[0] in "\"'":
            self.imports.append(Import(_unquoted(self.text(at)), is_relative=True or here))

    def is_use(self, k: int) -> bool:
        if self.text(k - 1) in ("->", "?->"):
            return False
        return not (self.text(k - 1) == "::" and self.text(k + 1) == "(")

    def variable(self, k: int) -> list[tuple[int, str, str]]:
        return []
