"""A small Go front end: tokens with automatic semicolons, and the features of each function.

It reads declarations, types and top-level statements only; that is all that
the similarity metrics look at.
"""

from __future__ import annotations

import hashlib
import re

#: Names that normalisation leaves alone.
BUILTIN_NAMES = frozenset(
    """bool byte complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr
    append cap close complex copy delete imag len make new panic print println real recover true false iota nil""".split()
)
#: Type names that stay in the token string.
BASIC_TYPES = frozenset("bool byte complex64 complex128 float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr".split())
_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_BINARY = frozenset("+ - * / % & | ^ << >> &^ && || == != < <= > >=".split())
_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|`[^`]*`)|(?P<char>'(?:\\.[^']*|[^'\\\n])')
    |(?P<number>(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?|0[bBoO][\d_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?)|(?P<name>[^\W\d]\w*)
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!(){}\[\],;.:~])""",
    re.S | re.X,
)
_ENDS = frozenset(") ] } ++ -- break continue fallthrough return".split())


class GoSyntaxError(ValueError):
    """A file that cannot be read; it gives no functions."""


class Token:
    __slots__ = ("at", "kind", "line", "text")

    def __init__(self, kind: str, text: str, line: int, at: int = 0) -> None:
        self.kind, self.text, self.line, self.at = kind, text, line, at


def tokens(source: str) -> list[Token]:
    """Tokens without comments; an automatic semicolon is an ``op`` with text ``\\n``."""
    out: list[Token] = []
    line, at = 1, 0

    def end_line() -> None:
        if out and (out[-1].kind in ("name", "number", "string", "char") or out[-1].text in _ENDS):
            out.append(Token("op", "\n", line))

    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise GoSyntaxError(f"line {line}: unexpected {source[at]!r}")
        kind, text = m.lastgroup, m.group()
        at = m.end()
        if kind == "line" or kind == "comment" and text.startswith("/*") and "\n" in text:
            end_line()
        elif kind not in ("space", "comment"):
            out.append(Token("keyword" if text in _KEYWORDS else kind, text, line, at - len(text)))
        line += text.count("\n")
    end_line()
    return out


_CLOSE = {"(": ")", "[": "]", "{": "}"}


def matching(toks: list[Token]) -> dict[int, int]:
    """Index of each opening bracket's closing one."""
    open_, out = [], {}
    for i, t in enumerate(toks):
        if t.kind == "op" and t.text in _CLOSE:
            open_.append(i)
        elif t.kind == "op" and t.text in (")", "]", "}"):
            if not open_ or _CLOSE[toks[open_[-1]].text] != t.text:
                raise GoSyntaxError(f"line {t.line}: unexpected {t.text}")
            out[open_.pop()] = i
    if open_:
        raise GoSyntaxError(f"line {toks[open_[-1]].line}: {toks[open_[-1]].text} is not closed")
    return out


def _split(toks: list[Token], a: int, b: int, at: frozenset | set, pair: dict[int, int]) -> list[tuple[int, int]]:
    """[a, b) cut at the given texts, brackets skipped."""
    out, start, i = [], a, a
    while i < b:
        if toks[i].kind == "op" and i in pair:
            i = pair[i]
        elif toks[i].kind == "op" and toks[i].text in at:
            out.append((start, i))
            start = i + 1
        i += 1
    out.append((start, b))
    return [(x, y) for x, y in out if x < y]


def _body(toks: list[Token], a: int, b: int, pair: dict[int, int]) -> int:
    """Index of the ``{`` that ends the header begun at a, or b. Braces of
    literals, types and function literals in the header are passed over."""
    opened = {y: x for x, y in pair.items()}
    i = a
    while i < b:
        t = toks[i]
        if t.text == "func" and t.kind == "keyword":
            i += 1
            while i < b and not (toks[i].text == "{" and toks[i - 1].text not in ("struct", "interface")):
                i = pair[i] + 1 if i in pair else i + 1
            i = pair[i] if i < b else i
        elif t.kind == "op" and t.text == "{":
            j = i - 1
            while j > a and (toks[j].kind == "name" or toks[j].text in (".", "*")):
                j -= 1
            typed = toks[i - 1].text in ("struct", "interface") or i - 1 in opened and toks[opened[i - 1] - 1].text in ("struct", "interface")
            if toks[j].text == "]" and opened.get(j, a) > a:
                before = toks[opened[j] - 1]
                typed = typed or before.text == "map" or not _is_operand_end(before)
            if not typed:
                return i
            i = pair[i]
        elif t.kind == "op" and i in pair:
            i = pair[i]
        i += 1
    return b


def _statements(toks: list[Token], a: int, b: int, pair: dict[int, int]) -> list[tuple[int, int]]:
    """The statements of the block [a, b). A semicolon in the header of a for,
    if or switch, after a label or an else too, belongs to the header."""
    out, start, i = [], a, a
    while i < b:
        t = toks[i]
        begins = i == start or toks[i - 1].text == "else" or toks[i - 1].text == ":" and i - 2 == start
        if begins and t.kind == "keyword" and t.text in ("for", "if", "switch", "select"):
            body = _body(toks, i + 1, b, pair)
            i = pair[body] if body < b else i
        elif t.kind == "op" and i in pair:
            i = pair[i]
        elif t.kind == "op" and t.text in ("\n", ";"):
            out.append((start, i))
            start = i + 1
        i += 1
    out.append((start, b))
    return [(x, y) for x, y in out if x < y]


def _print_type(toks: list[Token]) -> str:
    """A type in canonical spacing."""
    out = ""
    for i, t in enumerate(toks):
        text, before = t.text, toks[i - 1].text if i else ""
        if text == "\n":
            text = "; "
        glue = not out or text in (")", "]", ",", ".", "; ", "...") and text != "..." or before in ("(", "[", ".", "*", "...", "]", "\n", "&", "~") or before == "<-" and (i < 2 or toks[i - 2].text != "chan") or text in ("(", "[") and before in ("func", "map", ")", "interface", "struct") or text == "[" and toks[i - 1].kind == "name" or text == "<-" and before == "chan" or text == "{" or before == "{" or text == "}"
        if text == "(" and before == ")":
            glue = False
        out += text if glue else " " + text
    return out.replace("interface {", "interface{").replace("struct {", "struct{")


def _shape(toks: list[Token]) -> str:
    """The syntax node of a type."""
    first, text = toks[0], toks[0].text
    if first.kind == "name":
        return "*ast.Ident" if len(toks) == 1 else "*ast.SelectorExpr" if toks[1].text == "." and len(toks) == 3 else "*ast.IndexExpr"
    named = {"*": "*ast.StarExpr", "[": "*ast.ArrayType", "map": "*ast.MapType", "chan": "*ast.ChanType", "<-": "*ast.ChanType", "func": "*ast.FuncType", "interface": "*ast.InterfaceType", "struct": "*ast.StructType", "...": "*ast.Ellipsis", "(": "*ast.ParenExpr"}
    return named.get(text, "unknown")


class _Fields:
    """A parameter or result list: fields of (names, type tokens)."""

    def __init__(self, toks: list[Token], a: int, b: int, pair: dict[int, int]) -> None:
        items = _split(toks, a, b, {",", "\n"}, pair)

        def named(x: int, y: int) -> bool:
            return y - x > 1 and toks[x].kind == "name" and toks[x + 1].text != "." and not (toks[x + 1].text == "[" and pair[x + 1] == y - 1 and pair[x + 1] > x + 2)

        self.fields: list[tuple[list[str], list[Token]]] = []
        if any(named(x, y) for x, y in items):
            names: list[str] = []
            for x, y in items:
                names.append(toks[x].text)
                if y - x > 1:
                    self.fields.append((names, toks[x + 1 : y]))
                    names = []
            if names:
                raise GoSyntaxError(f"line {toks[a].line}: a parameter has no type")
        else:
            self.fields = [([], toks[x:y]) for x, y in items]

    def text(self) -> str:
        return ", ".join((", ".join(n) + " " if n else "") + _print_type(t) for n, t in self.fields)


def _kind(toks: list[Token], a: int, b: int, pair: dict[int, int]) -> str:
    """The syntax node of the statement [a, b)."""
    first = toks[a]
    simple = {"return": "Return", "go": "Go", "defer": "Defer", "select": "Select", "if": "If", "var": "Decl", "const": "Decl", "type": "Decl", "break": "Branch", "continue": "Branch", "goto": "Branch", "fallthrough": "Branch"}
    top, i, header = [], a, b
    while i < b:
        if toks[i].kind == "op" and i in pair:
            if toks[i].text == "{" and header == b:
                header = i
            i = pair[i]
        else:
            top.append(i)
        i += 1
    texts = {toks[i].text for i in top if toks[i].kind in ("op", "keyword")}
    if first.kind == "keyword" and first.text in simple:
        name = simple[first.text]
    elif first.text == "for":
        name = "Range" if any(toks[i].text == "range" for i in top if i < header) else "For"
    elif first.text == "switch":
        name = "TypeSwitch" if any(toks[i].text == "type" for i in range(a, header)) else "Switch"
    elif first.text == "{":
        name = "Block"
    elif first.kind == "name" and a + 1 < b and toks[a + 1].text == ":":
        name = "Labeled"
    elif texts & _ASSIGN:
        name = "Assign"
    elif texts & {"++", "--"}:
        name = "IncDec"
    elif any(toks[i].text == "<-" and i > a and (toks[i - 1].kind in ("name", "number", "string") or toks[i - 1].text in (")", "]", "}")) for i in top):
        name = "Send"
    else:
        name = "Expr"
    return f"*ast.{name}Stmt"


def _is_operand_end(t: Token) -> bool:
    return t.kind in ("name", "number", "string", "char") or t.text in (")", "]", "}")


def _returns_binary(toks: list[Token], a: int, b: int, pair: dict[int, int]) -> bool:
    for x, y in _split(toks, a + 1, b, {","}, pair):
        i = x
        while i < y:
            if toks[i].kind == "op" and i in pair:
                i = pair[i]
            elif i > x and toks[i].text in _BINARY and _is_operand_end(toks[i - 1]):
                return True
            i += 1
    return False


def _complexity(toks: list[Token], a: int, b: int, pair: dict[int, int]) -> int:
    inner = {}
    for i in range(a, b):
        if toks[i].text == "switch" or toks[i].text == "select":
            j = i + 1
            while j < b and not (toks[j].text == "{" and toks[j].kind == "op"):
                j = pair[j] + 1 if j in pair and toks[j].text != "{" else j + 1
            if j < b:
                inner[i] = (j, pair[j])
    n = 1
    for i in range(a, b):
        if toks[i].kind != "keyword":
            continue
        if toks[i].text in ("if", "for", "switch"):
            n += 1
        elif toks[i].text in ("case", "default"):
            holder = max((k for k, (x, y) in inner.items() if x < i < y), default=None)
            n += holder is not None and toks[holder].text == "switch"
    return n


def token_string(toks: list[Token]) -> str:
    """The normalised token string: names but basic types are IDENT, literals are their kind."""
    out = []
    for t in toks:
        if t.kind == "name":
            out.append(t.text if t.text in BASIC_TYPES else "IDENT")
        elif t.kind == "number":
            out.append("0i" if t.text.endswith("i") and not t.text.startswith("0x") else "NUMBER")
        elif t.kind == "string":
            out.append("STRING")
        else:
            out.append("'_'" if t.kind == "char" else t.text)
    return " ".join(out)


def normalized_text(toks: list[Token], functions: set[str], types: set[str], variables: set[str]) -> str:
    """Names by what they stand for, literals by their kind; two functions are
    alike but for names and literals if these texts are equal."""
    out = []
    for i, t in enumerate(toks):
        if t.kind == "name" and t.text not in BUILTIN_NAMES:
            member = i and toks[i - 1].text == "."
            out.append("ID" if member else "VAR" if t.text in variables else "FUNC" if t.text in functions else "TYPE" if t.text in types else "ID")
        elif t.kind == "number":
            out.append("0i" if t.text.endswith("i") else "0.0" if "." in t.text or re.search(r"(?i)^\d.*e", t.text) else "0")
        else:
            out.append({"string": '""', "char": "'_'"}.get(t.kind, t.text))
    return " ".join(out)


def identity_hash(name: str, signature: str, start: int, end: int, count: int, statements: int | None) -> str:
    """The first 16 hex digits of the SHA-256 of a function's name, signature, lines and size."""
    size = "nil_ast" if statements is None and start == 0 else "" if statements is None else f"stmts:{statements}"
    parts = [name, signature, f"lines:{start}-{end}", f"count:{count}", size]
    return hashlib.sha256(f"[{' '.join(p for p in parts if p)}]".encode()).hexdigest()[:16]


def _declared(toks: list[Token], a: int, b: int, pair: dict[int, int]) -> set[str]:
    """Names that the tokens [a, b) declare with := or var or as parameters of literals."""
    out: set[str] = set()
    for i in range(a, b):
        if toks[i].text == ":=":
            j = i - 1
            while j >= a and (toks[j].kind == "name" or toks[j].text == ","):
                if toks[j].kind == "name":
                    out.add(toks[j].text)
                j -= 1
        elif toks[i].text in ("var", "const") and i + 1 < b and toks[i + 1].kind == "name":
            out.add(toks[i + 1].text)
        elif toks[i].text == "func" and i + 1 in pair:
            for names, _ in _Fields(toks, i + 2, pair[i + 1], pair).fields:
                out.update(names)
    return out


def functions(source: str) -> list[dict]:
    """The features of each function declared with a body, in order."""
    toks = tokens(source)
    pair = matching(toks)
    if len(toks) < 2 or toks[0].text != "package" or toks[1].kind != "name":
        raise GoSyntaxError("line 1: no package clause")
    package, decls, i = toks[1].text, [], 2
    names, types = set(), set()
    while i < len(toks):
        t = toks[i]
        if t.text in ("\n", ";"):
            i += 1
            continue
        if t.text not in ("func", "type", "var", "const", "import"):
            raise GoSyntaxError(f"line {t.line}: {t.text!r} outside a declaration")
        end = i
        while end < len(toks) and toks[end].text not in ("\n", ";"):
            end = pair[end] + 1 if end in pair and toks[end].kind == "op" else end + 1
        if t.text == "func":
            decls.append((i, end))
        elif t.text == "type" and toks[i + 1].kind == "name":
            types.add(toks[i + 1].text)
        i = end
    parsed = []
    for a, b in decls:
        i, receiver = a + 1, None
        if i in pair:
            receiver, i = _Fields(toks, i + 1, pair[i], pair), pair[i] + 1
        if i >= b or toks[i].kind != "name":
            raise GoSyntaxError(f"line {toks[a].line}: a function has no name")
        name, i, generic = toks[i].text, i + 1, None
        if i < b and toks[i].text == "[":
            generic, i = _Fields(toks, i + 1, pair[i], pair), pair[i] + 1
        if i >= b or toks[i].text != "(":
            raise GoSyntaxError(f"line {toks[a].line}: {name} has no parameters")
        params, i = _Fields(toks, i + 1, pair[i], pair), pair[i] + 1
        body = i
        while body < b and not (toks[body].text == "{" and toks[body].kind == "op" and toks[body - 1].text not in ("interface", "struct")):
            body = pair[body] + 1 if body in pair and toks[body].text != "{" else body + 1 if body not in pair else pair[body] + 1
        results = _Fields(toks, i + 1, pair[i], pair) if i < body and toks[i].text == "(" and pair[i] == body - 1 else _Fields(toks, i, body, pair)
        if receiver is None:
            names.add(name)
        parsed.append((a, b, name, receiver, generic, params, results, body))
    out = []
    for a, b, name, receiver, generic, params, results, body in parsed:
        if body >= b:
            continue  # declared elsewhere
        if pair[body] != b - 1:
            raise GoSyntaxError(f"line {toks[pair[body]].line}: unexpected text after a body")
        many = len(results.fields) > 1 or any(n for n, _ in results.fields)
        signature = "func" + (f"[{generic.text()}]" if generic else "") + f"({params.text()})" + (f" ({results.text()})" if many else f" {results.text()}" if results.fields else "")
        statements = _statements(toks, body + 1, pair[body], pair)
        for x, y in statements:
            if toks[x].text in _BINARY - {"*", "&", "-", "+", "^"} or toks[y - 1].text in _BINARY | _ASSIGN:
                raise GoSyntaxError(f"line {toks[y - 1].line}: a statement is not complete")
        own = set().union(*(set(n) for f in (receiver, generic, params, results) if f for n, _ in f.fields), _declared(toks, body, b, pair))

        def plain(t: list[Token]) -> str:
            shape = _shape(t)
            say = lambda x: x.text if x.text in BUILTIN_NAMES else "TYPE" if x.text in types else "ID"  # noqa: E731, B023
            if shape == "*ast.Ident":
                return say(t[0])
            if shape == "*ast.StarExpr":
                return "*" + plain(t[1:])
            return "ID.ID" if shape == "*ast.SelectorExpr" else "unknown"

        kinds = [_kind(toks, x, y, pair) for x, y in statements]
        start, end = toks[a].line, toks[b - 1].line
        text_toks = [*toks[a:b], Token("op", "\n", end)]
        back = [plain(t) for _, t in results.fields]
        struct_sig = "func(" + ", ".join(plain(t) for _, t in params.fields) + ")" + (" (" + ", ".join(back) + ")" if len(back) > 1 else " " + back[0] if back else "")
        out.append({
            "package": package, "name": name, "start_line": start, "end_line": end, "line_count": end - start + 1, "signature": signature, "struct_sig": struct_sig,
            "source": source[toks[a].at : toks[b - 1].at + len(toks[b - 1].text)], "token_str": token_string(text_toks), "stmt_kinds": kinds, "stmt_count": len(kinds), "has_body": True,
            "ret_binop": any(toks[x].text == "return" and _returns_binary(toks, x, y, pair) for x, y in statements),
            "norm_hash": hashlib.sha256(normalized_text(text_toks, names, types, own).encode()).hexdigest(),
            "complexity": _complexity(toks, body, b, pair),
            "shape_sig": "_".join([name, *(_shape(t) for f in (params, results) for _, t in f.fields)]),
            "hash": identity_hash(name, signature, start, end, end - start + 1, len(kinds)),
        })
    return out
