"""Rule patterns are written in a linear-time regex dialect (Unicode classes,
no lookaround, no backreferences); Spark matches with ``java.util.regex``.

:func:`to_java` rewrites a pattern so that Java gives the same hits:

* ``\\d \\w \\s \\b`` become their Unicode forms whatever the JDK's defaults;
* ``(?i)`` is spelled out per letter with simple case folding.  Java's own
  Unicode case folding would also let dotted/dotless Turkish i match ``i``;
* ``.`` stops only at ``\\n`` and ``$`` is the very end of the text.

Patterns using anything the dialect lacks raise ``ValueError``, which is how
policies are validated before they enter the control table.
"""

from __future__ import annotations

_WORD = r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\p{IsJoin_Control}"
_CLASS_BODY = {
    "d": r"\p{Nd}", "D": r"\P{Nd}",
    "s": r"\p{IsWhite_Space}", "S": r"\P{IsWhite_Space}",
    "w": f"[{_WORD}]", "W": f"[^{_WORD}]",
}
_ASSERTIONS = {"b": r"(?U:\b)", "B": r"(?U:\B)", "A": r"\A", "z": r"\z"}
_CONTROL = {"n": "\n", "r": "\r", "t": "\t", "a": "\x07", "f": "\x0c", "v": "\x0b"}
_POSIX = {
    "alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z",
    "lower": "a-z", "space": r"\t\n\x0B\f\r ", "blank": r"\t ", "word": r"\w",
    "xdigit": "0-9A-Fa-f", "punct": r"!-/:-@\[-`{-~", "cntrl": r"\x00-\x1F\x7F",
    "print": " -~", "graph": "!-~", "ascii": r"\x00-\x7F",
}
# characters that fold to an ASCII letter besides its own other case
_EXTRA_FOLDS = {"s": "\u017f", "k": "\u212a"}
# Properties that both dialects know; others are refused, since a pattern that
# does not compile would end the job that uses it.
_CATEGORIES = frozenset("L Lu Ll Lt Lm Lo M Mn Mc Me N Nd Nl No P Pc Pd Ps Pe Pi Pf Po S Sm Sc Sk So Z Zs Zl Zp C Cc Cf Co Cn".split())
_SCRIPTS = frozenset("latin greek cyrillic han hiragana katakana arabic hebrew thai hangul devanagari alphabetic".split())
_CATEGORY_NAMES = {
    "letter": "L", "mark": "M", "number": "N", "punctuation": "P", "symbol": "S",
    "separator": "Z", "other": "C", "uppercase_letter": "Lu",
    "lowercase_letter": "Ll", "decimal_number": "Nd",
}


def _same_letter(ch: str) -> str:
    """All characters equal to *ch* under simple case folding."""
    low = ch.lower()
    low = "s" if low == "\u017f" else low
    forms = {ch} | {f for f in (low, ch.upper()) if len(f) == 1}
    return "".join(sorted(forms)) + _EXTRA_FOLDS.get(low, "")


def _quote(ch: str) -> str:
    if ch.isalnum() or ch in " _" or ord(ch) > 127:
        return ch
    return f"\\x{{{ord(ch):x}}}" if ord(ch) < 32 or ord(ch) == 127 else "\\" + ch


class _Translator:
    def __init__(self, pattern: str):
        self.src, self.at = pattern, 0

    def fail(self, why: str):
        raise ValueError(f"invalid regex: {why} at {self.at}: {self.src!r}")

    def peek(self, n: int = 1) -> str:
        return self.src[self.at:self.at + n]

    def take(self) -> str:
        if self.at >= len(self.src):
            self.fail("unexpected end")
        self.at += 1
        return self.src[self.at - 1]

    def until(self, stop: str) -> str:
        end = self.src.find(stop, self.at)
        if end < 0:
            self.fail(f"missing {stop}")
        body, self.at = self.src[self.at:end], end + len(stop)
        return body

    # -- one group body, up to ')' or the end ------------------------------
    def body(self, flags: frozenset, depth: int) -> str:
        parts: list[str] = []
        can_repeat = False
        while self.at < len(self.src) and self.peek() != ")":
            ch = self.take()
            if ch in "*+?" or ch == "{":
                if not can_repeat:
                    self.fail("nothing to repeat")
                parts[-1] = self.repeat(parts[-1], ch)
                continue
            can_repeat = ch != "|"
            if ch == "|":
                parts.append("|")
            elif ch == "(":
                atom, flags = self.group(flags, depth)
                can_repeat = atom is not None
                parts.append(atom or "")
            elif ch == "[":
                parts.append(self.char_class(flags))
            elif ch == "\\":
                parts.append(self.escape(flags))
            elif ch == ".":
                parts.append("(?s:.)" if "s" in flags else r"[^\n]")
            elif ch == "^":
                parts.append("(?dm:^)" if "m" in flags else r"\A")
            elif ch == "$":
                parts.append("(?dm:$)" if "m" in flags else r"\z")
            else:
                parts.append(self.literal(ch, flags))
        if depth == 0 and self.at < len(self.src):
            self.fail("unopened group")
        return "".join(parts)

    def repeat(self, atom: str, op: str) -> str:
        if op == "{":
            bounds = self.until("}")
            low, comma, high = bounds.partition(",")
            if not low.strip().isdecimal() or (high.strip() and not high.strip().isdecimal()):
                self.fail("bad repetition")
            if high.strip() and int(high) < int(low):
                self.fail("bad repetition range")
            op = "{" + low.strip() + comma + high.strip() + "}"
        lazy = ""
        if self.peek() == "?":
            lazy = self.take()
        # wrapped, so a second operator repeats the repetition and can never
        # be read as Java's possessive form
        again = self.peek() in ("*", "+", "?", "{")
        return f"(?:{atom}{op}{lazy})" if again else f"{atom}{op}{lazy}"

    def group(self, flags: frozenset, depth: int):
        head = "("
        inner = flags
        if self.peek() == "?":
            self.take()
            if self.peek(2) == "P<" or (self.peek() == "<" and self.peek(2) not in ("<=", "<!")):
                self.until("<")
                name = self.until(">")
                if not name.isidentifier():
                    self.fail("bad group name")
                head = "("
            elif self.peek() in ("<", "=", "!", ">", "P", "|", "#"):
                self.fail("look-around and atomic groups are not supported")
            else:
                spec = ""
                while self.peek() not in (":", ")", ""):
                    spec += self.take()
                on, _, off = spec.partition("-")
                if set(on + off) - set("imsu") or "u" in off or (not spec and self.peek() == ")"):
                    self.fail(f"unsupported flags {spec!r}")
                inner = (flags | set(on)) - set(off)
                if self.take() == ")":
                    return None, inner
                head = "(?:"
        text = self.body(inner, depth + 1)
        if self.take() != ")":
            self.fail("unclosed group")
        return f"{head}{text})", flags

    # -- atoms --------------------------------------------------------------
    def literal(self, ch: str, flags: frozenset) -> str:
        if "i" in flags and len(_same_letter(ch)) > 1:
            return f"[{_same_letter(ch)}]"
        return _quote(ch)

    def code_point(self, kind: str) -> str:
        if self.peek() == "{":
            self.take()
            digits = self.until("}")
        else:
            digits = "".join(self.take() for _ in range({"x": 2, "u": 4, "U": 8}[kind]))
        try:
            return chr(int(digits, 16))
        except (ValueError, OverflowError):
            self.fail("bad code point")

    def property(self, letter: str) -> str:
        name = self.take()
        if name == "{":
            name = self.until("}")
        negate = (letter == "P") != name.startswith("^")
        name = name.lstrip("^").split("=")[-1].split(":")[-1]
        plain = _CATEGORY_NAMES.get(name.lower(), name)
        if plain not in _CATEGORIES and plain.lower() not in _SCRIPTS:
            self.fail("unknown property")
        java = plain if plain in _CATEGORIES else "Is" + plain
        return f"\\{'P' if negate else 'p'}{{{java}}}"

    def escape(self, flags: frozenset) -> str:
        ch = self.take()
        if ch in _CLASS_BODY:
            return _CLASS_BODY[ch]
        if ch in _ASSERTIONS:
            if self.peek() == "{" and ch in "bB":
                self.fail("unsupported word boundary form")
            return _ASSERTIONS[ch]
        if ch in "pP":
            return self.property(ch)
        return self.literal(self.escaped_char(ch), flags)

    def escaped_char(self, ch: str) -> str:
        if ch in "xuU":
            return self.code_point(ch)
        if ch in _CONTROL:
            return _CONTROL[ch]
        if ch.isalnum() or ord(ch) > 127 or ch in "<> ":
            self.fail(f"unrecognised escape \\{ch}")
        return ch

    def char_class(self, flags: frozenset) -> str:
        out = "[^" if self.peek() == "^" and self.take() else "["
        first = True
        while True:
            if self.peek(2) in ("--", "~~") and not first and self.src[self.at + 2:self.at + 3] != "]":
                self.fail("unsupported class operator")
            ch = self.take()
            if ch == "]" and not first:
                return out + "]"
            first = False
            if ch == "[":
                if self.peek() == ":":
                    self.take()
                    name = self.until(":]")
                    bare = name.lstrip("^")
                    if bare not in _POSIX:
                        self.fail(f"unknown class {name!r}")
                    out += f"[^{_POSIX[bare]}]" if name != bare else _POSIX[bare]
                else:
                    out += self.char_class(flags)
                continue
            if ch == "&" and self.peek() == "&":
                self.take()
                out += "&&"
                continue
            if ch == "\\":
                ch = self.take()
                if ch in _CLASS_BODY:
                    out += _CLASS_BODY[ch]
                    continue
                if ch in "pP":
                    out += self.property(ch)
                    continue
                ch = self.escaped_char(ch)
            high = ch
            if self.peek() == "-" and self.src[self.at + 1:self.at + 2] not in ("]", ""):
                self.take()
                high = self.take()
                if high == "\\":
                    high = self.escaped_char(self.take())
            if high < ch:
                self.fail("bad class range")
            out += self.folded_range(ch, high, flags)

    def folded_range(self, low: str, high: str, flags: frozenset) -> str:
        text = _quote(low) if low == high else f"{_quote(low)}-{_quote(high)}"
        if "i" not in flags:
            return text
        if low != high and ord(high) > 127:
            self.fail("case-insensitive class ranges must be ASCII")
        members = {chr(c) for c in range(ord(low), ord(high) + 1)}
        extra = {f for m in members for f in _same_letter(m)} - members
        return text + "".join(_quote(f) for f in sorted(extra))


def to_java(pattern: str, starts: str = "") -> str:
    """Java form of *pattern*.

    *starts* is an optional character class body holding every character a
    match can begin with.  It is tested first, so the costlier word-boundary
    test only runs where a match may start; it never changes the result.
    """
    java = _Translator(pattern).body(frozenset(), 0)
    guard = f"(?={_Translator('[' + starts + ']').body(frozenset(), 0)})" if starts else ""
    return f"{guard}(?:{java})" if guard else java
