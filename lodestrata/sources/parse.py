"""Functions, complexity, parameters and public items of source texts.

Python goes through its own syntax trees, block by block where a file has errors; the brace languages through a scanner:
comments and strings are blanked, braces matched, and the extent of every construct found. Differences to a full grammar:
code inside macros counts like any other.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256

from lodestrata.sources import script

Row = tuple  # (name, start_line, end_line, loc, params, cyclomatic, cognitive, body_hash)
BRACES = ("rust", "typescript", "javascript", "go")
MASKS = {
    "rust": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|b?r(#*)\".*?\"\1|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'", re.S),
    "go": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.[^'\n]*|[^'\\\n])'", re.S),
}
# Fixed values of the metrics: keywords that branch (each adds 1 to cyclomatic complexity and 1 with the nesting to the
# cognitive), those that nest, and operators that add 1 to both.
BRANCHES = {"rust": ("if", "while", "loop", "for"), "go": ("if", "for"), "js": ("if", "while", "do", "for", "catch")}
WIDE = {"rust": ("match",), "go": ("switch", "select"), "js": ("switch",)}
NESTS = {"rust": ("if", "while", "loop", "for", "match"), "go": ("if", "for", "switch", "select"), "js": ("if", "while", "do", "for", "switch", "try")}
LOGIC = {"rust": r"&&|\|\|", "go": r"&&|\|\|", "js": r"(?:&&|\|\||\?\?)(?!=)"}
NO_METHODS = frozenset("if for while switch catch function return with await new typeof else do super import constructor_".split())
PAIRS = {"(": ")", "[": "]", "{": "}"}


def mask(source: str, lang: str, tags: bool = False) -> str:
    """The source with comments blanked, and strings but for their quotes, at the same places."""
    if lang == "js":
        return script.blank(source, tags)

    def cover(m: re.Match) -> str:
        text = re.sub(r"[^\n]", " ", m[0])
        return text if m[0][0] == "/" else f'"{text[1:-1]}"'
    return MASKS[lang].sub(cover, source)


class Text:
    """A masked source with its line starts and matching brackets."""

    def __init__(self, source: str, lang: str, path: str = ""):
        self.source, self.lang = source, "js" if lang in ("typescript", "javascript") else lang
        self.code = mask(source, self.lang, lang == "javascript" or not path.endswith((".ts", ".mts", ".cts")))
        self.ends: dict[int, int] = {}  # of constructs that are known
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        stack: list[int] = []
        for m in re.finditer(r"[()\[\]{}]", self.code):
            c = m[0]
            if c in PAIRS:
                stack.append(m.start())
            else:
                while stack and PAIRS[self.code[stack[-1]]] != c:
                    stack.pop()
                if stack:
                    self.open[m.start()] = stack[-1]
                    self.close[stack.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def skip(self, at: int) -> int:
        while at < len(self.code) and self.code[at].isspace():
            at += 1
        return at

    def body(self, at: int, stop: str = ";") -> int | None:
        """The next { outside of brackets, or None if a stop or the end comes first."""
        while at < len(self.code):
            c = self.code[at]
            if c == "{":
                return at
            if c in "([":
                at = self.close.get(at, len(self.code))
            elif c in stop or c in ")]}":
                return None
            at += 1
        return None

    def end_of_expression(self, at: int) -> int:
        while at < len(self.code):
            c = self.code[at]
            if c in PAIRS:
                at = self.close.get(at, len(self.code))
            elif c in ",;)]}":
                return at
            at += 1
        return at

    def before(self, at: int) -> str:
        at -= 1
        while at >= 0 and self.code[at].isspace():
            at -= 1
        return self.code[at] if at >= 0 else ""

    def extent(self, word: str, at: int) -> int:
        """Where the construct that a keyword begins ends. Constructs that it holds should be asked for first."""
        if at not in self.ends:
            self.ends[at] = self._extent(word, at)
        return self.ends[at]

    def _extent(self, word: str, at: int) -> int:
        after = at + len(word)
        if word == "do" or word in ("loop", "try"):
            b = self.skip(after)
            b = b if self.code[b : b + 1] == "{" else None
        elif self.lang == "js":
            p = self.skip(after)
            end = self.close.get(p, p) if self.code[p : p + 1] == "(" else p - 1
            b = self.skip(end + 1)
            if self.code[b : b + 1] != "{":
                end = self.statement_end(b)
                return self._else(end) if word == "if" else end
        else:
            b = self.body(after, "") if self.lang == "go" else self.body(after)
        if b is None:
            return after
        end = self.close.get(b, len(self.code)) + 1
        if word == "if":
            return self._else(end)
        if word in ("try", "do"):
            while m := re.compile(r"\s*(catch|finally)\b").match(self.code, end):
                c = self.body(m.end())
                if c is None:
                    break
                end = self.close.get(c, len(self.code)) + 1
            if word == "do" and (m := re.compile(r"\s*while\s*\(").match(self.code, end)):
                end = self.close.get(m.end() - 1, len(self.code)) + 1
        return end

    def statement_end(self, at: int) -> int:
        m = re.compile(r"(if|for|while|do|switch|try)\b").match(self.code, at)
        if m:
            return self.extent(m[1], at)
        end = self.end_of_expression(at)
        return end + 1 if self.code[end : end + 1] == ";" else end

    def _else(self, end: int) -> int:
        m = re.compile(r"\s*else\b\s*").match(self.code, end)
        if not m:
            return end
        at = m.end()
        if re.compile(r"if\b").match(self.code, at):
            return self.extent("if", at)
        if self.code[at : at + 1] == "{":
            return self.close.get(at, len(self.code)) + 1
        return self.statement_end(at) if self.lang == "js" else end


OPERAND = re.compile(r"[\w)\]}\"'?]")


def in_type(t: Text, at: int) -> bool:
    """Whether a question mark belongs to a type: `extends` stands before it in the same expression."""
    b = at
    while b > 0:
        c = t.code[b - 1]
        if c in ")]}":
            b = t.open.get(b - 1, b - 1)
        elif c in "([{;,?:" or c == "=" and t.code[b : b + 1] != ">":
            break
        else:
            b -= 1
    return re.search(r"\bextends\b", t.code[b:at]) is not None


class Ranges:
    """Intervals [a, b): which places lie inside of any, and inside of how many after their beginning."""

    def __init__(self, ranges: list[tuple[int, int]]):
        self.starts, self.ends, self.outer = sorted(a for a, _ in ranges), sorted(b for _, b in ranges), []
        for a, b in sorted(ranges):
            if self.outer and a < self.outer[-1][1]:
                self.outer[-1][1] = max(b, self.outer[-1][1])
            else:
                self.outer.append([a, b])

    def hold(self, at: int) -> bool:
        i = bisect_right(self.outer, at, key=lambda r: r[0]) - 1
        return i >= 0 and at < self.outer[i][1]

    def depth(self, at: int) -> int:
        return bisect_left(self.starts, at) - bisect_right(self.ends, at)


def inner_functions(t: Text, a: int, b: int) -> list[tuple[int, int]]:
    """Ranges of functions, closures and function literals inside a body."""
    out, code = [], t.code
    if t.lang == "rust":
        for m in re.compile(r"\bfn\s+\w+").finditer(code, a, b):
            if (x := t.body(m.end())) is not None:
                out.append((m.start(), t.close.get(x, b)))
        for m in re.compile(r"\|\||\|(?=[^|=])").finditer(code, a, b):
            if any(x <= m.start() < y for x, y in out) or (OPERAND.match(t.before(m.start()) or " ") and not re.search(r"\b(?:move|return|else|in)\s*$", code[max(a, m.start() - 12) : m.start()])):
                continue
            end = m.end() if m[0] == "||" else code.find("|", m.end(), b) + 1
            if not end:
                continue
            at = t.skip(end)
            if code.startswith("->", at):
                at = t.body(at) or at
            out.append((m.start(), t.close.get(at, b) if code[at : at + 1] == "{" else t.end_of_expression(at)))
    elif t.lang == "go":
        for m in re.compile(r"\bfunc\s*\(").finditer(code, a, b):
            x = t.close.get(m.end() - 1, b) + 1
            if (x := t.body(x)) is not None:
                out.append((m.start(), t.close.get(x, b)))
    else:
        for m in re.compile(r"\bfunction\b\s*\*?\s*[\w$]*\s*(?:<[^>(]*>)?\(").finditer(code, a, b):
            if (x := t.body(t.close.get(m.end() - 1, b) + 1)) is not None:
                out.append((m.start(), t.close.get(x, b)))
        for m in re.compile(r"=>\s*").finditer(code, a, b):
            out.append((m.start(), t.close.get(m.end(), b) if code[m.end() : m.end() + 1] == "{" else t.end_of_expression(m.end())))
        for name, s, _, x in methods(t, a, b):
            out.append((s, t.close.get(x, b)))
    return out


def complexity(t: Text, a: int, b: int) -> tuple[int, int]:
    """(cyclomatic, cognitive) of a body, functions inside left out."""
    code, lang = t.code, t.lang
    hidden = Ranges(inner_functions(t, a + 1, b)).hold
    nests: list[tuple[int, int]] = []
    marks: list[tuple[int, bool, bool]] = []  # place, adds to cyclomatic, adds to cognitive with its nesting
    ends_of_do: set[int] = set()
    words = re.compile(r"\b(" + "|".join({*BRANCHES[lang], *WIDE[lang], *NESTS[lang]}) + r")\b").finditer(code, a, b)
    for m in reversed(list(words)):  # so that the end of what stands inside is known
        w, p = m[1], m.start()
        if hidden(p) or t.before(p) == "." or lang == "rust" and w == "for" and re.match(r"for\s*<", code[p : p + 8]):
            continue
        if w == "for" and lang == "rust" and not re.compile(r"for\b[^{;]*?\bin\b").match(code, p):
            continue
        if lang == "js" and code[m.end() : m.end() + 1] == ":":
            continue
        end = t.extent(w, p)
        if w == "do" and (x := code.rfind("while", p, end)) > 0:
            ends_of_do.add(x)
        if w in NESTS[lang]:
            nests.append((p, end))
        if w in BRANCHES[lang]:
            marks.append((p, True, True))
        elif w in WIDE[lang]:
            marks.append((p, False, True))
    if lang == "rust":
        marks += [(m.start(), True, False) for m in re.compile(r"=>").finditer(code, a, b)]
        marks += [(m.start(), True, True) for m in re.compile(r"(?<=[\w)\]}>])\?(?![\w:])").finditer(code, a, b)]
    elif lang == "go":
        marks += [(m.start(), True, False) for m in re.compile(r"\bcase\b").finditer(code, a, b)]
    else:
        marks += [(m.start(), True, False) for m in re.compile(r"\bcase\b|\bdefault\s*:").finditer(code, a, b)]
        marks += [(m.start(), True, True) for m in re.compile(r"(?<!\?)\?(?!\.\D|[?:)=,;])").finditer(code, a, b) if not in_type(t, m.start())]
    nests = Ranges([(x, y) for x, y in nests if x not in ends_of_do])
    cc, cog = 1, 0
    for p, one, two in marks:
        if hidden(p) or p in ends_of_do:
            continue
        cc += one
        cog += two and 1 + nests.depth(p)
    for m in re.compile(LOGIC[lang]).finditer(code, a, b):
        if not hidden(m.start()) and OPERAND.match(t.before(m.start()) or " "):
            cc += 1
            cog += 1
    return cc, cog


def split_top(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and text[i - 1 : i] not in ("-", "="):
            depth -= 1
        elif c == "," and depth <= 0:
            out.append(text[at:i])
            at = i + 1
    return [x.strip() for x in [*out, text[at:]] if x.strip()]


def count_params(text: str, lang: str) -> int:
    parts = split_top(text)
    if lang == "rust":
        return sum(not re.match(r"(?:&\s*(?:'\w+\s+)?)?(?:mut\s+)?self\b", re.sub(r"#\[[^\]]*\]\s*", "", p)) for p in parts)
    if lang == "go":
        typed = [bool(re.match(r"\w+\s+\S", p)) for p in parts]
        return sum(typed) if any(typed) else len(parts)
    return sum(not re.match(r"this\b", p) for p in parts)


def methods(t: Text, a: int = 0, b: int | None = None) -> Iterator[tuple[str, int, int, int]]:
    """(name, start, opening parenthesis, opening brace) of methods in classes and object literals."""
    head = re.compile(
        r"(?:(?<=[{};,])|^)\s*((?:(?:public|private|protected|static|async|override|readonly|abstract|get|set|export|declare)\s+)*\*?\s*(#?[A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\s*\()", re.M
    )
    for m in head.finditer(t.code, a, len(t.code) if b is None else b):
        if m[2] in NO_METHODS:
            continue
        p = m.end() - 1
        end = t.close.get(p)
        if end is None:
            continue
        at = t.skip(end + 1)
        if t.code[at : at + 1] == ":":
            at = t.body(at + 1, ";=")
            if at is None:
                continue
        if t.code[at : at + 1] == "{" and not re.match(r"\b(?:if|for|while|switch|catch)\b", m[2]):
            yield m[2], m.start(1), p, at


def functions(lang: str, source: str, path: str = "") -> list[Row]:
    """Named functions and methods in order, also those inside others."""
    if lang == "python":
        return _python(source)
    if lang not in BRACES:
        return []
    t = Text(source, lang, path)
    code, found = t.code, []
    if lang == "rust":
        for m in re.finditer(r"((?:\b(?:pub(?:\s*\([^)]*\))?|async|unsafe|const|default|extern(?:\s+\"[^\"]*\")?)\s+)*)\bfn\s+(\w+)", code):
            p = code.find("(", m.end())
            if p >= 0 and (b := t.body(t.close.get(p, len(code)) + 1)) is not None:
                found.append((m[2], m.start(), p, b))
    elif lang == "go":
        for m in re.finditer(r"^func\s*(?:(\([^)]*\))\s*)?(\w+)\s*(?:\[[^\]]*\]\s*)?\(", code, re.M):
            p = m.end() - 1
            b = t.close.get(p, len(code)) + 1
            r = t.skip(b)
            b = t.close.get(r, r) + 1 if code[r : r + 1] == "(" else b
            if (b := t.body(b, "\n")) is not None:
                found.append((m[2], m.start(), p, b))
    else:
        for m in re.finditer(r"(?:\basync\s+)?\bfunction\b\s*(\*?)\s*([\w$]+)\s*(?:<[^>(]*>)?\(", code):
            if lang == "typescript" and m[1] or re.search(r"(?:[=(,:?\[!&|]|\b(?:return|new|await|typeof))$", code[: m.start()].rstrip()[-8:]):
                continue
            p = m.end() - 1
            if (b := t.body(t.close.get(p, len(code)) + 1)) is not None:
                found.append((m[2], m.start(), p, b))
        seen = {b for _, _, _, b in found}
        found += [x for x in methods(t) if x[3] not in seen]
    out = []
    for name, s, p, b in sorted(found, key=lambda x: x[1]):
        end = t.close.get(b, len(code) - 1)
        cc, cog = complexity(t, b, end)
        first, last = t.line(s), t.line(end)
        out.append((name, first, last, last - first + 1, count_params(code[p + 1 : t.close.get(p, p)], lang), cc, cog, _hash(source[b : end + 1])))
    return out


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()[:16]


#: Comments and strings of Python, also ones that don't end.
QUOTED = re.compile(r"#[^\n]*|(\"\"\"|''').*?(?:\1|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.S)
HEAD = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", re.M)
#: Statements of a broken function that may be passed over.
PASSED_OVER = 20


def _python(source: str) -> list[Row]:
    tree = _tree(source)
    found = _tree_functions(tree, source, 0) if tree else _block_functions(source)
    return sorted(found, key=lambda r: (r[1], -r[2]))


def _tree(source: str) -> ast.Module | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _block_functions(source: str) -> list[Row]:
    """Functions of a file with errors: blocks by indentation are parsed each. A block that has an error is parsed again with
    the broken statement passed over; a class, and a function that can't be mended, give the blocks inside them."""
    code = QUOTED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    lines, covered = source.split("\n"), code.split("\n")
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    indent = [len(x) - len(x.lstrip()) if x.strip() else -1 for x in covered]  # -1: nothing but blanks, comments and strings
    out, done = [], 0
    for head in HEAD.finditer(code):
        first = bisect_right(starts, head.start()) - 1
        if first < done:
            continue
        column, at, depth = len(head[1]), head.end(), 0
        while at < len(code) and (depth or code[at] not in ":\n"):  # the head may go over lines
            depth += (code[at] in "([{") - (code[at] in ")]}")
            if code[at] == "\n" and HEAD.match(code, at + 1):  # a bracket that isn't closed
                break
            at += 1
        last = stop = bisect_right(starts, min(at, len(code) - 1))
        while stop < len(lines) and not 0 <= indent[stop] <= column:
            stop += 1
            last = stop if lines[stop - 1].strip() else last
        while last > first + 1 and not lines[last - 1].strip():
            last -= 1
        block = [x[column:] if x[:column].strip() == "" else x for x in lines[first:last]]
        tree = _tree("\n".join(block))
        for _ in range(PASSED_OVER if head[2] == "def" and not tree else 0):
            try:
                tree = ast.parse("\n".join(block))
                break
            except (ValueError, RecursionError, MemoryError):
                break
            except SyntaxError as e:
                at = (e.lineno or 1) - 1
                if not 0 < at < len(block) or block[at].strip() == "pass":
                    break
                block[at] = block[at][: len(block[at]) - len(block[at].lstrip())] + "pass"
        if tree:
            out += _tree_functions(tree, "\n".join(block), first)
            done = last
        elif head[2] == "def" and not depth and code[at : at + 1] == ":":
            out.append((head[3], first + 1, last, last - first, 0, 1, 0, _hash("\n".join(lines[first + 1 : last]).strip())))
    return out


def _tree_functions(tree: ast.Module, source: str, before: int) -> list[Row]:
    """Functions of a tree of source, which has so many lines before it in its file."""
    lines, out = source.splitlines(keepends=True), []

    def walk(node, nesting: int, total: list[int]) -> None:
        for child in ast.iter_child_nodes(node):
            visit(child, nesting, total)

    def add(total, nesting: int, cc: int = 1) -> None:
        total[0] += cc
        total[1] += 1 + nesting

    def visit(x, n: int, total: list[int], elif_: bool = False) -> None:
        if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda):
            return
        if isinstance(x, ast.If):
            add(total, n)
            inner = n if elif_ else n + 1
            visit(x.test, inner, total)
            for y in x.body:
                visit(y, inner, total)
            if len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If) and lines[x.orelse[0].lineno - 1][x.orelse[0].col_offset :].startswith("elif"):
                visit(x.orelse[0], inner, total, True)
            else:
                for y in x.orelse:
                    visit(y, inner, total)
            return
        if isinstance(x, ast.While | ast.For | ast.AsyncFor):
            add(total, n)
            walk(x, n + 1, total)
        elif isinstance(x, ast.Try | ast.TryStar):
            walk(x, n + 1, total)
        elif isinstance(x, ast.ExceptHandler | ast.IfExp):
            add(total, n)
            walk(x, n, total)
        elif isinstance(x, ast.BoolOp):
            total[0] += len(x.values) - 1
            total[1] += len(x.values) - 1
            walk(x, n, total)
        else:
            walk(x, n, total)

    for f in ast.walk(tree):
        if not isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef):
            continue
        total = [1, 0]
        for s in f.body:
            visit(s, 0, total)
        a = f.args
        plain = [*a.posonlyargs, *a.args]
        params = sum(not (p.arg in ("self", "cls") and p.annotation is None) for p in plain) + len(a.kwonlyargs) + (a.vararg is not None) + (a.kwarg is not None)
        last = f.end_lineno or f.lineno
        body = "".join(lines[f.body[0].lineno - 1 : last])
        out.append((f.name, f.lineno + before, last + before, last - f.lineno + 1, params, *total, _hash(body.strip())))
    return out


# Public items: (kind, name, signature, line, method)
ROUTES = {
    "rust": re.compile(r'\.route\(\s*"(?P<path>[^"]+)"\s*,\s*(?P<method>get|post|put|delete|patch|options|head)\b'),
    "js": re.compile(r"\w+\.(?P<method>get|post|put|delete|patch|options|head)\(\s*['\"](?P<path>[^'\"]+)['\"]"),
    "python": re.compile(r"@\w+\.(?P<method>get|post|put|delete|patch|options|head)\(\s*['\"](?P<path>[^'\"]+)['\"]"),
}
RUST_ITEM = re.compile(
    r"(?P<pub>pub(?:\s*\([^)]*\))?\s+)?(?:(?:async|unsafe|const(?=\s+(?:async\s+|unsafe\s+|extern\s|fn\b))|extern(?:\s+\"[^\"]*\")?|default)\s+)*"
    r"(?P<kind>fn|struct|enum|trait|type|union|const|static|use|mod|impl|macro_rules!)\b\s*(?:mut\s+)?(?P<name>\w+)?"
)
RUST_KINDS = {"fn": "function", "struct": "type", "enum": "type", "trait": "type", "type": "type", "union": "type", "const": "constant", "static": "constant"}
EXPORT = re.compile(r"^[ \t]*export\b", re.M)


def surface(lang: str, source: str, path: str = "") -> list[tuple]:
    out = []
    if lang == "rust":
        t = Text(source, lang)
        _rust_items(t, 0, len(t.code), out)
    elif lang in ("typescript", "javascript"):
        _exports(Text(source, lang, path), out)
    route = ROUTES.get("js" if lang in ("typescript", "javascript") else lang)
    if route:
        out += [("http_route", m["path"], None, source.count("\n", 0, m.start()) + 1, m["method"].upper()) for m in route.finditer(source)]
    return out


def _rust_items(t: Text, a: int, b: int, out: list) -> None:
    at = a
    while at < b:
        at = t.skip(at)
        if at >= b:
            return
        if t.code[at] == "#":
            x = t.code.find("[", at, b)
            at = t.close.get(x, at) + 1 if x >= 0 else at + 1
            continue
        m = RUST_ITEM.match(t.code, at, b)
        if not m:
            at = t.close.get(at, at) + 1
            continue
        kind, name, line = m["kind"], m["name"], t.line(at)
        brace = t.body(m.end())
        semi = t.code.find(";", m.end(), b)
        if kind == "use" or kind in ("const", "static", "type") and semi >= 0:
            end = semi if semi >= 0 else b
            depth = t.end_of_expression(m.end()) if kind in ("const", "static") else end
            end = depth if kind in ("const", "static") and t.code[depth : depth + 1] == ";" else end
        elif brace is not None and (semi < 0 or brace < semi or t.code[m.end() : semi].count("(") != t.code[m.end() : semi].count(")")):
            end = t.close.get(brace, b)
        else:
            end = semi if semi >= 0 else b
        if kind == "mod" and brace is not None and end == t.close.get(brace, b):
            _rust_items(t, brace + 1, end, out)
        if m["pub"]:
            if kind == "mod":
                out.append(("module", name, None, line, None))
            elif kind == "use":
                text = t.source[at:end].strip().rstrip(";")
                out.append(("re_export", text.rsplit("::", 1)[-1].strip(), None, line, None))
            elif kind in RUST_KINDS and name:
                out.append((RUST_KINDS[kind], name, t.source[at:brace].strip() if kind == "fn" and brace is not None else None, line, None))
        at = end + 1


def _exports(t: Text, out: list) -> None:
    outer: list[tuple[int, int]] = []  # braces that no other holds
    for x, y in sorted(t.close.items()):
        if t.code[x] == "{" and (not outer or x > outer[-1][1]):
            outer.append((x, y))
    for m in EXPORT.finditer(t.code):
        at = m.end() - 6
        i = bisect_left(outer, (at,)) - 1
        if i >= 0 and at < outer[i][1]:
            continue
        rest, line = t.code[m.end() : m.end() + 1000], t.line(at)  # as much as a head may take
        if re.match(r"\s*(?:type\s+)?(?:\*|\{)", rest):
            end = t.code.find(";", m.end())
            nl = t.code.find("\n", t.close.get(t.code.find("{", m.end()), m.end()) if re.match(r"\s*(?:type\s+)?\{", rest) else m.end())
            end = min(x for x in (end if end >= 0 else len(t.code), nl if nl >= 0 else len(t.code)))
            text = t.source[at : end + 1].strip()
            if re.search(r"\bfrom\b", t.code[at : end + 1]):
                out.append(("re_export", text.replace("\n", " ")[:64], None, line, None))
        elif re.match(r"\s*default\b", rest):
            out.append(("function", "default", None, line, None))
        elif d := re.match(r"\s*(?:declare\s+)?(?:async\s+)?function\b\s*\*?\s*([\w$]+)", rest):
            out.append(("function", d[1], None, line, None))
        elif d := re.match(r"\s*(?:declare\s+)?(?:abstract\s+)?(?:class|interface|type|(?:const\s+)?enum)\s+([\w$]+)", rest):
            out.append(("type", d[1], None, line, None))
        elif d := re.match(r"\s*(?:declare\s+)?(?:const|let|var)\s+", rest):
            end = t.code.find(";", m.end() + d.end())
            body = t.code[m.end() + d.end() : end if end >= 0 else len(t.code)]
            for i, part in enumerate(split_top(body)):
                n = re.match(r"[\w$]+(?=\s*[:=]|\s*$)", part)
                if n and (i == 0 or "=" in part):
                    out.append(("constant", n[0], None, line, None))
