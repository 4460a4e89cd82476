"""Where the inline scripts of a page lead, as far as one reading of their tokens tells.

A script of any length is cut once, from left to right, into words, strings, regular
expressions and marks, with comments left out and the depth of open brackets kept, so the
time is in line with the length.  Tokens are judged as they come and then forgotten, so
memory isn't.  Only statements outside all brackets run for certain; of these only ones
with a constant target are sure.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Characters of one script and of all scripts of a page that within_budget() lets through.
MAX_SCRIPT, MAX_SCRIPTS = 65536, 262144
#: Tokens of a script that are gathered before those of whole statements are judged, and those kept as what came before.
PIECE, BEHIND = 4096, 4
#: Names of the page's own window and document, and windows whose new address replaces the page.
PLACES = frozenset(["window", "self", "top", "parent", "frames", "globalThis", "document", "this"])
SAME_WINDOW = frozenset(["_self", "_top", "_parent"])
#: Parts of an address; reading one goes nowhere, and setting the hash doesn't leave the page.
PARTS = frozenset(["href", "search", "host", "hostname", "pathname", "protocol", "origin", "port", "hash"])
#: Words after which a slash begins a regular expression, and those that hold a statement of their own behind brackets or at once.
BEFORE_VALUE = frozenset("return typeof case in of delete void throw new instanceof else do yield await".split())
TESTS, HANGING = frozenset("if for while with catch switch".split()), frozenset("else do".split())
#: What a script that can move the page holds; each match has one of the words.
WORDS = ("location", "open", "submit", "click", "eval", "Function")
MENTION = re.compile(r"location|open\s*\(|submit|click|\beval\b|\bFunction\b")

_TOKEN = re.compile(
    r"""(?P<space>[ \t\v\f\r\xa0\ufeff]++)|(?P<line>[\n\u2028\u2029])
    |(?P<note>//[^\n\u2028\u2029]*+|<!--[^\n]*+|(?m:^)-->[^\n]*+|/\*(?s:.*?)\*/)
    |(?P<word>[A-Za-z_$\u0080-\U0010ffff][\w$]*+)|(?P<number>\.?[0-9][\w.]*+)
    |(?P<text>"(?:[^"\\\n]++|\\(?s:.))*+"|'(?:[^'\\\n]++|\\(?s:.))*+')
    |(?P<mark>=>|={1,3}|!={0,2}|[-+*%&|^<>?]+=?|/=?|[{}()\[\];,.:~@\#])""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[A-Za-z]*+")
#: The same where a class is known not to end in its line, or nothing after it.
_CLASSLESS = re.compile(r"/(?![*/])(?:[^/\\\[\n]++|\\.)++/[A-Za-z]*+")
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\(?s:.)|\$(?!\{))*+")
_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]+)\}|(\r\n|(?s:.)))")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\u2028": "", "\u2029": ""}
_CLOSES = {")": "(", "]": "[", "}": "{"}


def unescaped(text: str) -> str | None:
    """What a string literal's inside spells; null where it isn't text that can be written."""
    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        return chr(int(code, 16)) if code else _PLAIN.get(m[4], m[4])

    try:
        whole = _ESCAPE.sub(one, text) if "\\" in text else text
        return whole.encode("utf-16", "surrogatepass").decode("utf-16")
    except (ValueError, OverflowError):
        return None


@dataclass
class Tokens:
    """The tokens of a script: kind (w, n, s, r, or m for marks), text, depth, and whether a statement begins there."""

    kinds: list[str] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    begins: list[bool] = field(default_factory=list)


class _Unclosed(Exception):
    pass


def pieces_of(script: str) -> Iterator[tuple[Tokens, int, int]]:
    """The tokens of a script piece by piece, each with the first one that is new and the end of those to judge.

    A piece ends before a statement or after a comma, where no target is cut in two.  The same
    lists are given again, less what lies further back.  Raises _Unclosed if strings, comments
    or brackets don't close.
    """
    out = Tokens()
    kinds, texts, depths, begins = out.kinds, out.texts, out.depths, out.begins
    stack: list[tuple[str, bool]] = []  # an open bracket, and whether it is that of a test
    at, n, begin, line = 0, len(script), True, False
    hangs = False  # a statement that follows belongs to what is before it
    first = 0  # the first token that wasn't judged
    barred = 0  # where a line ends in which an expression was begun that doesn't end

    def put(kind: str, text: str | None) -> None:
        nonlocal begin, line, hangs
        if line and not hangs and kinds and not begin:
            # a line end ends a statement that can end there, unless what follows goes on with it
            last, goes_on = texts[-1], kind == "m" and text not in ("{", "!", "~", "++", "--") or kind == "r" or text in ("in", "of", "instanceof")
            ends = kinds[-1] in "wnsr" and last not in BEFORE_VALUE or kinds[-1] == "m" and last in (")", "]", "}", "++", "--")
            begin = ends and not goes_on
        kinds.append(kind)
        texts.append(text)
        depths.append(len(stack))
        begins.append(begin and not hangs)
        begin, line, hangs = False, False, kind == "w" and text in HANGING

    def template(at: int) -> int:
        """Past the piece of a template that begins at `at`: its end, or the bracket that opens in it."""
        end = _TEMPLATE.match(script, at).end()
        if script.startswith("${", end):
            stack.append(("`", False))
            return end + 2
        return end + 1 if end < n else -1

    def parts() -> bool:
        """Whether the last token begins a statement or follows a comma that isn't one behind an address."""
        comma = kinds[-2] == "m" and texts[-2] == ","
        return begins[-1] or comma and not (kinds[-3] == "s" and kinds[-4] == "m" and texts[-4] in ("(", "+"))

    while at < n:
        if len(kinds) >= PIECE + BEHIND and parts():
            yield out, first, len(kinds) - 1
            for x in (kinds, texts, depths, begins):
                del x[: -BEHIND - 1]
            first = BEHIND
        c = script[at]
        if c == "`":
            end = template(at + 1)
            if end < 0:
                raise _Unclosed
            put("s", unescaped(script[at + 1 : end - 1]) if script[end - 1] == "`" else None)
            at = end
            continue
        if c == "/" and not script.startswith(("//", "/*"), at):
            value = kinds and (kinds[-1] in "ns" or kinds[-1] == "w" and texts[-1] not in BEFORE_VALUE or texts[-1] in (")", "]") and kinds[-1] == "m")
            m = None if value else (_CLASSLESS if at < barred else _REGEX).match(script, at)
            if m:
                put("r", None)
                at = m.end()
                continue
            if not value and at >= barred:
                # what doesn't end only fails at the end of its line, and so does all in it that gets to a class
                end = script.find("\n", at)
                barred = n if end < 0 else end
        m = _TOKEN.match(script, at)
        if m is None:
            raise _Unclosed
        kind, text, at = m.lastgroup, m[0], m.end()
        if kind == "space":
            continue
        if kind == "line" or kind == "note":
            line = line or kind == "line" or "\n" in text
        elif kind == "text":
            put("s", unescaped(text[1:-1]))
        elif kind != "mark":
            put(kind[0], text)
        elif text in ("(", "[", "{"):
            test = text == "(" and kinds and kinds[-1] == "w" and texts[-1] in TESTS
            put("m", text)
            stack.append((text, bool(test)))
            begin = text == "{"
        elif text in _CLOSES:
            if not stack:
                raise _Unclosed
            opened, test = stack.pop()
            if opened == "`":
                if text != "}" or (at := template(at)) < 0:
                    raise _Unclosed
                continue
            if opened != _CLOSES[text]:
                raise _Unclosed
            # a["b"] is a.b
            if text == "]" and len(kinds) > 2 and kinds[-1] == "s" and texts[-2] == "[" and kinds[-2] == "m" and texts[-1] is not None and (kinds[-3] == "w" or texts[-3] in (")", "]")):
                kinds[-1], texts[-2] = "w", "."
                continue
            put("m", text)
            begin, hangs = text == "}", test
        else:
            if text == "/" and script.startswith("*", at):
                raise _Unclosed
            put("m", text)
            begin = text == ";"
    if stack:
        raise _Unclosed
    yield out, first, len(kinds)


def mentions(script: str) -> bool:
    """Whether a script can move the page, told by words before a pattern is tried at each place."""
    return "location" in script or any(w in script for w in WORDS) and MENTION.search(script) is not None


def sinks(script: str) -> tuple[list[str], int, int]:
    """The sure targets of a script in order, how many other ways out it has, and how many more it may take in ways that aren't read."""
    try:
        return _sinks(script) if mentions(script) else ([], 0, 0)
    except _Unclosed:
        return [], 0, 0


def _sinks(script: str) -> tuple[list[str], int, int]:
    kinds, texts, depths, begins, n = [], [], [], [], 0
    mark = lambda i, text: kinds[i] == "m" and texts[i] == text
    targets, loose, soft = [], 0, 0
    left = False  # code after a statement that leaves the script doesn't run

    def constant(i: int) -> tuple[str | None, int]:
        """The text that begins at i, strings and what is added to them, and where it ends."""
        if kinds[i] != "s" or texts[i] is None:
            return None, i
        parts = [texts[i]]
        while mark(i + 1, "+") and kinds[i + 2] == "s" and texts[i + 2] is not None:
            parts.append(texts[i + 2])
            i += 2
        return "".join(parts), i + 1

    def sure(first: int, end: int) -> bool:
        return begins[first] and not depths[first] and not left and (end >= n or mark(end, ";") or begins[end])

    chain = 0  # where the dotted name that holds the word begins
    places = True
    timed, said = False, 0  # whether strings may be run, and how many could move the page if they are
    for t, first, stop in pieces_of(script):
        kinds, texts, depths, begins, n = [*t.kinds, *"mmmm"], [*t.texts, *[""] * 4], t.depths, t.begins, len(t.kinds)
        for i in range(first, stop):
            if kinds[i] == "s":
                said += texts[i] is not None and mentions(texts[i])
                continue
            if kinds[i] != "w":
                continue
            word = texts[i]
            timed = timed or word in ("setTimeout", "setInterval", "execScript")
            left = left or begins[i] and not depths[i] and word in ("throw", "return", "break")
            if i and mark(i - 1, "."):
                # names before this one lead to the page's own window
                places = places and i > 1 and kinds[i - 2] == "w" and texts[i - 2] in PLACES
            else:
                chain, places = i, True
            if word == "location" and places and not (mark(i + 1, ":") and i and (mark(i - 1, "{") or mark(i - 1, ","))):
                part = texts[i + 2] if mark(i + 1, ".") and kinds[i + 2] == "w" else None
                if part in ("replace", "assign") and mark(i + 3, "("):
                    target, end = constant(i + 4)
                    if target is not None and mark(end, ")") and sure(chain, end + 1):
                        targets.append(target)
                    else:
                        loose += 1
                elif part is None or part == "href":
                    at = i + 1 if part is None else i + 3
                    if mark(at, "="):
                        target, end = constant(at + 1)
                        if target is not None and sure(chain, end):
                            targets.append(target)
                        else:
                            loose += 1
                    elif part is None or kinds[at] == "m" and texts[at].endswith("=") and texts[at] not in ("==", "===", "!=", "!==", "<=", ">="):
                        loose += 1
                elif part == "reload":
                    soft += 1
                elif part in PARTS and part != "hash" and mark(i + 3, "="):
                    loose += 1
            elif word == "open" and places and mark(i + 1, "(") and not (i and mark(i - 1, ".") and texts[i - 2] == "document"):
                target, end = constant(i + 2)
                if target is not None and mark(end, ")"):
                    continue  # a new window
                name, close = constant(end + 1) if target is not None and mark(end, ",") else (None, end)
                if name is not None and name not in SAME_WINDOW:
                    continue
                if name is not None and mark(close, ")") and sure(chain, close + 1):
                    targets.append(target)
                else:
                    loose += 1
            elif word in ("submit", "click") and i and mark(i - 1, ".") and mark(i + 1, "(") and mark(i + 2, ")"):
                soft += 1
            elif word == "eval" and mark(i + 1, "(") or word == "Function" and i and texts[i - 1] == "new":
                soft += 1
    return targets, loose, soft + (said if timed else 0)


def sinks_of(scripts: list[str]) -> tuple[list[str], int, int]:
    """sinks() of all scripts of one page together."""
    targets, loose, soft = [], 0, 0
    for s in scripts:
        found, more, may = sinks(s)
        targets += found
        loose += more
        soft += may
    return targets, loose, soft


def within_budget(scripts: list[str]) -> list[str]:
    """The scripts of one page without those that are too long or would take the sum past the limit; no query leaves any out."""
    kept, held = [], 0
    for s in scripts:
        if len(s) <= MAX_SCRIPT and held + len(s) <= MAX_SCRIPTS:
            held += len(s)
            kept.append(s)
    return kept
