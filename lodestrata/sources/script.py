"""Blanks what isn't code in JavaScript and TypeScript, in one pass with a stack of modes.

Code, template, substitution, tag and the text between tags each have their own rules for what ends them. In the result,
at the same places: comments, texts and names of tags are blanks, strings and regular expressions blanks between quotes, and
templates, substitutions, elements and their expressions stand in parentheses, so that each is one operand and the code in
them stays.
"""

from __future__ import annotations

import re

CODE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|\+\+|--|=>|[\w$]+|[^\s\w$]", re.S)
TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*(`|\$\{)?", re.S)
TAG = re.compile(r"\"[^\"]*\"?|'[^']*'?|//[^\n]*|/\*.*?(?:\*/|\Z)|/\s*>|=>|[^\s]")
TEXT = re.compile(r"[^<{]*(\{|</[^>]*>?|<)?")
REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: What a tag begins with. A list of type parameters before a function is none.
OPENS = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?!\s*,|\s+extends\b)(?=[\s/>{<]))")
LONE = re.compile(r"<([\w$.:-]+)\s*>")
#: Words that an operand follows, and words whose parentheses a statement follows.
BEFORE_OPERAND = frozenset("return typeof case in of do else void delete throw new instanceof yield await default extends".split())
HEADS = frozenset("if while for with".split())


class Unclosed(Exception):
    """A tag that has no end: it was none."""


def blank(source: str, tags: bool) -> str:
    """source with its code only. tags: whether elements may stand in it."""
    try:
        return _blank(source, tags)
    except Unclosed:
        return _blank(source, False)


def _closed(source: str, at: int) -> bool:
    """Whether a tag of a name alone, which may be a type parameter as well, has its end somewhere."""
    m = LONE.match(source, at)
    return not m or source.find("</" + m[1], m.end()) >= 0


def _blank(source: str, tags: bool) -> str:
    out, size, at = list(source), len(source), 0
    stack: list[tuple[str, bool]] = []  # mode or bracket, and for a parenthesis whether a statement follows it
    operand, last = False, ""  # whether the last token ends an operand, and the token

    def clear(a: int, b: int, around: str = "") -> None:
        for i in range(a, b):
            if out[i] != "\n":
                out[i] = " "
        if around and b > a:
            out[a] = out[b - 1] = around

    def element_ends(a: int, b: int) -> None:
        clear(a, b)
        out[b - 1] = ")"

    while at < size:
        mode = stack[-1][0] if stack else ""
        if mode == "`":
            m = TEMPLATE.match(source, at)
            clear(at, m.end())
            at = m.end()
            if m[1] == "`":
                out[at - 1] = ")"
                stack.pop()
                operand, last = True, "`"
            elif m[1]:
                out[at - 1] = "("
                stack.append(("${", False))
                operand, last = False, "{"
            continue
        if mode == "tag" or mode == "<":  # "<": angle brackets inside of a tag, as of type arguments
            m = TAG.search(source, at)
            if not m:
                raise Unclosed
            t, at = m[0], m.end()
            clear(m.start(), at)
            if t == "{":
                out[m.start()] = "("
                stack.append(("{}", False))
                operand, last = False, "{"
            elif t == "<":
                stack.append(("<", False))
            elif t == ">" and mode == "<":
                stack.pop()
            elif t == ">":
                stack[-1] = ("text", False)
            elif t[0] == "/" and t[-1] == ">":
                stack.pop()
                element_ends(m.start(), at)
                operand, last = True, ">"
            continue
        if mode == "text":
            m = TEXT.match(source, at)
            if not m[1]:
                raise Unclosed
            clear(at, m.end())
            at = m.end()
            if m[1] == "{":
                out[at - 1] = "("
                stack.append(("{}", False))
                operand, last = False, "{"
            elif m[1] == "<":
                out[at - 1] = "("
                if source.startswith(">", at):  # an element without a name
                    at += 1
                    out[at - 1] = " "
                    stack.append(("text", False))
                else:
                    stack.append(("tag", False))
            else:
                stack.pop()
                element_ends(m.start(1), at)
                operand, last = True, ">"
            continue
        m = CODE.search(source, at)
        if not m:
            break
        t, a, at = m[0], m.start(), m.end()
        if t[:2] in ("//", "/*"):
            clear(a, at)
            continue
        if t[0] in "\"'":
            clear(a, at, t[0])
            operand = True
        elif t == "`":
            out[a] = "("
            stack.append(("`", False))
        elif t in "([{":
            stack.append((t, t == "(" and last in HEADS))
            operand = False
        elif t in ")]}":
            kind, statement = stack.pop() if stack else (t, False)
            if kind in ("${", "{}"):
                out[a] = ")"
            operand = t != "}" and not statement
        elif t == "/" and not operand and (r := REGEX.match(source, a)):
            at = r.end()
            clear(a, at, '"')
            operand = True
        elif t == "<" and tags and not operand and (r := OPENS.match(source, a)) and _closed(source, a):
            out[a] = "("
            if r[0] == "<>":
                out[a + 1], at = " ", a + 2
                stack.append(("text", False))
            else:
                stack.append(("tag", False))
        elif t[0].isalnum() or t[0] in "_$":
            operand = last == "." or t not in BEFORE_OPERAND
        elif t in ("++", "--") or t == "!" and operand and not source.startswith("=", at):
            pass  # stands after an operand as well as before one
        else:
            operand = False
        last = t
    if any(kind in ("tag", "text") for kind, _ in stack):
        raise Unclosed
    return "".join(out)
