"""Tokens of source files, with their brackets matched.

One scanner a family of languages, each with a stack of modes: brackets, template strings and their inserted code, JSX tags and their text,
heredocs and quoted words are on one stack, so that what a string or a comment holds is never taken for code. A closing bracket that fits none
is passed over, and one that fits an outer bracket closes that one: the damage of a broken file ends there. Time is linear in the text.
"""

from __future__ import annotations

import bisect
import re

#: Bracket pairs. ``${`` and ``#{`` open code inside a string.
CLOSES = {")": ("(",), "]": ("[",), "}": ("{", "${", "#{")}
_SPACE = re.compile(r"[^\S\n]+|\\\n")
_NAME = r"[^\W\d][\w]*"


class Tokens:
    """Parallel lists. kind: id, num, str, var, sym, attr, nl or op; line and stop: first and last line; place: where it begins in the source; match: the other bracket, or -1; up: the bracket around a token, or -1."""

    def __init__(self, source: str):
        self.source, self.at = source, 0
        self.text: list[str] = []
        self.kind: list[str] = []
        self.line: list[int] = []
        self.stop: list[int] = []
        self.place: list[int] = []
        self.match: list[int] = []
        self.up: list[int] = []
        self.space: list[bool] = []  # whether white space comes before
        self.gap = True
        self._starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self._open: list[tuple[str, int, int]] = []  # mode, its bracket, its text
        self.inserted: set[int] = set()  # braces that put code into a tag or its text
        self._waiting: dict[str, int] = {}
        self._around = [-1]

    def __len__(self) -> int:
        return len(self.text)

    def add(self, kind: str, text: str, at: int) -> int:
        self.text.append(text)
        self.kind.append(kind)
        self.line.append(bisect.bisect_right(self._starts, at))
        self.stop.append(self.line[-1] + text.count("\n") if kind == "str" else self.line[-1])
        self.place.append(at)
        self.match.append(-1)
        self.up.append(self._around[-1])
        self.space.append(self.gap)
        self.gap = False
        return len(self.text) - 1

    @property
    def mode(self) -> str:
        return self._open[-1][0] if self._open else ""

    def enter(self, mode: str, token: int = -1) -> None:
        """A bracket (with its token) or a mode begins; a quoted text's last token is what opened it."""
        self._open.append((mode, token, len(self.text) - 1))
        self._waiting[mode] = self._waiting.get(mode, 0) + 1
        self._around.append(token if token >= 0 else self._around[-1])

    def leave(self) -> tuple[str, int]:
        self._around.pop()
        mode, token, text = self._open.pop()
        self._waiting[mode] -= 1
        if token < 0 and text >= 0:
            self.stop[text] = max(self.stop[text], bisect.bisect_right(self._starts, max(0, self.at - 1)))
        return mode, token

    def punctuation(self, text: str, at: int) -> str:
        """An operator or a bracket; for a closing one, the bracket it closes."""
        if text in ("(", "[", "{", "${", "#{"):
            self.enter(text, self.add("op", text, at))
            return ""
        opened = ""
        if text in CLOSES and any(self._waiting.get(o) for o in CLOSES[text]):
            while True:
                opened, token = self.leave()
                if opened in CLOSES[text]:
                    break
            k = self.add("op", text, at)
            self.match[k], self.match[token] = token, k
            return opened
        self.add("op", text, at)
        return ""

    def previous(self, back: int = 1) -> str:
        return self.text[-back] if len(self.text) >= back else ""


def _possessive(quote: str) -> str:
    return rf"{quote}(?:\\[\s\S]|[^{quote}\\])*+{quote}?"


# --- languages with braces --------------------------------------------------------------------------------------------------------------

_OPS = r"===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|\.\.\.|\?->|<=>|=>|->|::|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\.=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|<-|[^\s\w]"
_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_WORD, _NUMBER = r"[^\W\d][\w$]*", r"\d[\w.]*"
_ONE_LINE = r'"(?:\\[\s\S]|[^"\\\n])*+"?|\'(?:\\[\s\S]|[^\'\\\n])*+\'?'
_JS = re.compile(rf"(?P<skip>\s+|{_COMMENT})|(?P<str>{_ONE_LINE})|(?P<id>[#$@]?{_WORD}|\$[\w$]*)|(?P<num>\.?{_NUMBER})|(?P<op>{_OPS})")
_JS_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*+\]|[^/\\\[\n])++/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|[^`\\$]|\$(?!\{))*+")
_TAG = re.compile(r"<(?:>|[A-Za-z][\w.:-]*(?=[\s/>]))")
_GENERIC = re.compile(r"<\s*(?:const\s+)?\w+\s*(?:,|extends\b|=[^>])|<\w+>\s*\(")
_TAG_PART = re.compile(r"(?P<skip>\s+|/\*[\s\S]*?\*/)|(?P<str>\"[^\"]*\"?|'[^']*'?)|(?P<end>/?>)|(?P<attr>[\w$][\w$:.-]*)|(?P<op>[\s\S])")
#: Words after which an expression begins.
BEFORE_VALUE = frozenset(("return", "typeof", "case", "in", "of", "delete", "void", "instanceof", "new", "throw", "do", "else", "yield", "await", "default", "extends"))


def _value_next(t: Tokens) -> bool:
    """Whether a value may begin here, so that a slash opens a regular expression and ``<`` a tag."""
    if not t.text:
        return True
    text, kind = t.text[-1], t.kind[-1]
    if kind == "op":
        if text == ")":
            head = t.match[-1] - 1
            return head >= 0 and t.text[head] in ("if", "while", "for", "with") and t.kind[head] == "id"
        return text not in ("]", "++", "--")
    return kind == "id" and text in BEFORE_VALUE


def _javascript(t: Tokens, types: bool) -> None:
    source = t.source
    while t.at < len(source):
        at, mode = t.at, t.mode
        if mode == "`":
            t.at = _TEMPLATE.match(source, at).end()
            if source.startswith("${", t.at):
                t.punctuation("${", t.at)
                t.at += 2
            else:
                t.at += 1
                t.leave()
        elif mode == "tag":
            _tag_part(t)
        elif mode == "kids":
            t.at = next((m.start() for m in [re.compile("[<{]").search(source, at)] if m), len(source))
            closing = re.compile(r"</[\s\w.:$-]*>?").match(source, t.at)
            if closing:
                t.leave()
                t.at = closing.end()
            elif source.startswith("{", t.at):
                t.inserted.add(len(t))
                t.punctuation("{", t.at)
                t.at += 1
            elif t.at < len(source):
                _tag(t)
        elif source[at] == "`":
            t.add("str", "`", at)
            t.enter("`")
            t.at += 1
        elif source[at] == "/" and _value_next(t) and (m := _JS_REGEX.match(source, at)):
            t.add("str", m[0], at)
            t.at = m.end()
        elif source[at] == "<" and _value_next(t) and _TAG.match(source, at) and not (types and _GENERIC.match(source, at)):
            _tag(t)
        else:
            m = _JS.match(source, at)
            t.at = m.end() if m else at + 1
            if m is None or m.lastgroup == "skip":
                t.gap = True
            elif m.lastgroup == "op":
                t.punctuation(m[0], at)
            else:
                t.add(m.lastgroup, m[0], at)


def _tag(t: Tokens) -> None:
    """The beginning of an element; ``<>`` has no name."""
    m = _TAG.match(t.source, t.at) or re.compile("<").match(t.source, t.at)
    t.add("op", "<tag", t.at)
    if len(m[0]) > 1 and m[0] != "<>":
        t.add("id", re.split(r"[.:]", m[0][1:])[0], t.at + 1)
    t.at = m.end()
    t.enter("kids" if m[0] == "<>" else "tag")


def _tag_part(t: Tokens) -> None:
    m = _TAG_PART.match(t.source, t.at)
    at, t.at = t.at, m.end()
    if m.lastgroup == "end":
        t.leave()
        if m[0] == ">":
            t.enter("kids")
    elif m.lastgroup == "op" and m[0] == "{":
        t.inserted.add(len(t))
        t.punctuation("{", at)
    elif m.lastgroup in ("str", "attr"):
        t.add(m.lastgroup, m[0], at)


_JAVA = re.compile(rf"(?P<skip>\s+|{_COMMENT})|(?P<str>\"\"\"(?:\\[\s\S]|(?!\"\"\")[\s\S])*+(?:\"\"\")?|{_ONE_LINE})|(?P<id>{_WORD}|\$[\w$]*)|(?P<num>\.?{_NUMBER})|(?P<op>\.\.\.|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|[^\s\w])")
_GO = re.compile(rf"(?P<skip>\s+|{_COMMENT})|(?P<str>`[^`]*`?|{_ONE_LINE})|(?P<id>{_WORD})|(?P<num>\.?{_NUMBER})|(?P<op>\.\.\.|:=|<-|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|[^\s\w])")


def _plain(t: Tokens, pattern: re.Pattern) -> None:
    """Languages whose strings hold no code."""
    for m in pattern.finditer(t.source):
        if m.lastgroup == "skip":
            t.gap = True
        elif m.lastgroup == "op":
            t.punctuation(m[0], m.start())
        else:
            t.add(m.lastgroup, m[0], m.start())


_PHP = re.compile(rf"(?P<end>\?>\n?)|(?P<skip>\s+|//(?:(?!\?>)[^\n])*|#(?!\[)(?:(?!\?>)[^\n])*|/\*[\s\S]*?(?:\*/|\Z))|(?P<str>{_possessive(chr(34))}|{_possessive(chr(39))}|{_possessive('`')})|(?P<var>\$+{_NAME})|(?P<id>{_NAME})|(?P<num>\.?{_NUMBER})|(?P<op>#\[|{_OPS})")
_PHP_OPEN = re.compile(r"<\?(?:php\b|=)?", re.IGNORECASE)
_HEREDOC = re.compile(r"<<<[ \t]*([\"']?)([^\W\d]\w*)\1[^\n]*\n")


def _php(t: Tokens) -> None:
    source, first = t.source, True
    while t.at < len(source):
        m = _PHP_OPEN.search(source, t.at)
        if m is None:
            return
        t.at, first = m.end(), False
        while t.at < len(source):
            here = _HEREDOC.match(source, t.at) if source.startswith("<<<", t.at) else None
            if here:
                close = re.compile(rf"^[ \t]*{here[2]}\b", re.MULTILINE).search(source, here.end() - 1)
                t.add("str", "<<<", t.at)
                t.at = close.end() if close else len(source)
                continue
            m = _PHP.match(source, t.at)
            at, t.at = t.at, m.end() if m else t.at + 1
            if m is None or m.lastgroup == "skip":
                t.gap = True
            elif m.lastgroup == "end":
                t.add("op", ";", at)
                break
            elif m.lastgroup == "op":
                t.punctuation("[" if m[0] == "#[" else m[0], at)
            else:
                t.add(m.lastgroup, m[0], at)


# --- languages with blocks that end in a word ---------------------------------------------------------------------------------------------

_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_RUBY = re.compile(
    r"(?P<skip>[^\S\n]+|\\\n|\#[^\n]*)|(?P<begin>^=begin\b[\s\S]*?(?:^=end\b[^\n]*|\Z))|(?P<end>^__END__$[\s\S]*)|(?P<nl>\n)|(?P<var>@@?[^\W\d]\w*|\$[^\W\d]\w*|\$[^\s\w])"
    rf"|(?P<sym>:{_NAME}[?!=]?(?![=>]*>)|:\"(?:\\[\s\S]|[^\"\\])*+\"|:(?:\[\]=?|<=>|===?|=~|[-+*/%<>!~^&|]+))|(?P<attr>{_NAME}[?!]?:(?!:))|(?P<id>{_NAME}(?:[?!](?!=(?!=)))?)|(?P<num>{_NUMBER})"
    r"|(?P<op>\*\*=|<=>|===|\|\|=|&&=|<<=|>>=|\.\.\.|&\.|=>|->|::|==|=~|!=|!~|<=|>=|[-+*/%|&^]=|\*\*|&&|\|\||<<|>>|\.\.|[^\s\w])", re.MULTILINE)  # fmt: skip
_RUBY_HERE = re.compile(r"<<([~-]?)([\"'`]?)([^\W\d]\w*)\2")
_RUBY_PERCENT = re.compile(r"%([wWiIqQrsx]?)([^\w\s])")
_RUBY_WORDS = frozenset((
    "alias", "and", "begin", "break", "case", "class", "def", "defined?", "do", "else", "elsif", "end", "ensure", "for", "if", "in", "module", "next", "not", "or",
    "redo", "rescue", "retry", "return", "super", "then", "undef", "unless", "until", "when", "while", "yield",
))
_ELIXIR = re.compile(
    r"(?P<skip>[^\S\n]+|\\\n|\#[^\n]*)|(?P<nl>\n)|(?P<attr>(?:[^\W\d]\w*[?!]?|\"(?:\\[\s\S]|[^\"\\\n])*+\"):(?=\s))|(?P<sym>:[^\W\d][\w@]*[?!]?|:\"(?:\\[\s\S]|[^\"\\])*+\")|(?P<var>@[^\W\d]\w*[?!]?)"
    rf"|(?P<id>{_NAME}[?!]?)|(?P<num>\?(?:\\.|[^\s])|{_NUMBER})|(?P<op>\|>|->|<-|=>|::|\\\\|==|!=|<=|>=|=~|&&|\|\||\+\+|--|<>|\.\.|[^\s\w])")  # fmt: skip
_SIGIL = re.compile(r"~([A-Za-z]+)(\"\"\"|'''|[(\[{<|/\"'])")


def _quoted(t: Tokens, close: str, opening: str, code: bool, what: str = "str") -> None:
    """The rest of a quoted text, whose first mark has been read; code that it inserts is scanned as code."""
    t.enter(f"q{close}\0{opening}\0{int(code)}\0{what}")


def _quoted_part(t: Tokens) -> None:
    close, opening, code, _ = t.mode[1:].split("\0")
    source, at, depth = t.source, t.at, 0
    stop = re.compile("|".join([r"\\[\s\S]", re.escape(close), *([re.escape(opening)] if opening else []), *([r"\#\{"] if code == "1" else [])]))
    while m := stop.search(source, at):
        at = m.end()
        if m[0] == "#{":
            t.at = at
            t.punctuation("#{", m.start())
            return
        if m[0] == close:
            if not depth:
                t.at = at
                t.leave()
                return
            depth -= 1
        elif opening and m[0] == opening:
            depth += 1
    t.at = len(source)


def _ruby_value_next(t: Tokens) -> bool:
    if not t.text or t.kind[-1] == "nl":
        return True
    if t.kind[-1] == "op":
        return t.text[-1] not in (")", "]", "}")
    return t.kind[-1] == "attr" or t.kind[-1] == "id" and t.text[-1] in _RUBY_WORDS and t.text[-1] not in ("end", "super") and t.previous(2) not in (".", "&.")


def _ruby(t: Tokens) -> None:
    source, waiting = t.source, []
    while t.at < len(source):
        at, mode = t.at, t.mode
        if mode.startswith("q"):
            _quoted_part(t)
            continue
        c = source[at]
        value, spaced = _ruby_value_next(t), t.gap
        after_space = bool(t.text) and t.kind[-1] == "id" and spaced and not source[at + 1 : at + 2].isspace()
        if c in "\"'`" and not (c == "`" and t.previous() in ("def", ".")):
            t.add("str", c, at)
            t.at += 1
            _quoted(t, c, "", c != "'")
        elif c == "<" and (value or after_space) and (m := _RUBY_HERE.match(source, at)) and (m[1] or m[2] or m[3].isupper()):
            t.add("str", m[0], at)
            t.at = m.end()
            waiting.append((m[3], bool(m[1])))
        elif c == "%" and (value or after_space) and (m := _RUBY_PERCENT.match(source, at)) and (value and m[2] != "=" or m[1] or m[2] in "([{<|"):
            t.add("str", m[0], at)
            t.at = m.end()
            _quoted(t, _PAIRS.get(m[2], m[2]), m[2] if m[2] in _PAIRS else "", m[1] not in ("q", "w", "i", "s"))
        elif c == "/" and (value or after_space):
            t.add("str", "/", at)
            t.at += 1
            _quoted(t, "/", "", True)
        elif c == "?" and value and re.match(r"\?(?:\\.|\w)(?!\w)", source[at : at + 4]):
            t.add("str", source[at : at + 2], at)
            t.at += 3 if source[at + 1] == "\\" else 2
        else:
            m = _RUBY.match(source, at)
            t.at = m.end() if m else at + 1
            if m is None or m.lastgroup == "skip":
                t.gap = True
            elif m.lastgroup == "nl":
                t.add("nl", "\n", at)
                for name, dented in waiting:  # the bodies of heredocs follow their line, in order
                    close = re.compile(rf"^{'[ \t]*' if dented else ''}{name}[ \t\r]*$", re.MULTILINE).search(source, t.at)
                    t.at = close.end() if close else len(source)
                waiting.clear()
                t.gap = True
            elif m.lastgroup == "begin":
                t.gap = True
            elif m.lastgroup == "end":
                return
            elif m.lastgroup == "attr" and (t.previous() == "?" or t.previous(2) == "?" and not value or t.previous() in (".", "&.")):
                t.add("id", m[0][:-1], at)  # a conditional's colon
                t.at -= 1
            elif m.lastgroup == "op":
                t.punctuation(m[0], at)
            else:
                t.add(m.lastgroup, m[0], at)


def _elixir(t: Tokens) -> None:
    source = t.source
    while t.at < len(source):
        at, mode = t.at, t.mode
        if mode.startswith("q"):
            _quoted_part(t)
            continue
        m = _SIGIL.match(source, at) if source[at] == "~" else None
        if m:
            t.add("str", m[0], at)
            t.at = m.end()
            _quoted(t, _PAIRS.get(m[2], m[2]), "", m[1].islower())
            continue
        m = _ELIXIR.match(source, at)
        if source[at] in "\"'" and not (m and m.lastgroup == "attr"):
            mark = source[at : at + 3] if source[at : at + 3] in ('"""', "'''") else source[at]
            t.add("str", mark, at)
            t.at += len(mark)
            _quoted(t, mark, "", True)
            continue
        t.at = m.end() if m else at + 1
        if m is None or m.lastgroup == "skip":
            t.gap = True
        elif m.lastgroup == "nl":
            t.add("nl", "\n", at)
            t.gap = True
        elif m.lastgroup == "op":
            t.punctuation(m[0], at)
        else:
            t.add(m.lastgroup, m[0], at)


def tokens(language: str, source: str) -> Tokens:
    """The tokens of a file of one of the languages below."""
    t = Tokens(source)
    scanners = {
        "javascript": lambda: _javascript(t, False), "typescript": lambda: _javascript(t, True), "java": lambda: _plain(t, _JAVA), "go": lambda: _plain(t, _GO),
        "php": lambda: _php(t), "ruby": lambda: _ruby(t), "elixir": lambda: _elixir(t),
    }
    scanners[language]()
    return t
