"""Column functions over source text: lines, words, counts.

Functions that take ``lines`` want a column made with ``split_lines`` one select earlier, so that the
text is cut once for all of them.

Character classes are spelled out rather than taken from the regex dialect, so that white space,
word characters and line breaks mean the same for every text and on every Java version.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Members of the three character classes, the usual ones first as they are tried in
# this order, and the members of the first once more as plain text.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A letter beyond the first 65536 code points is spelled out: Java's look-behind sees such letters
# whole only if the pattern holds one.
WORD = "a-zA-Z0-9_\U0001d400" + r"\p{L}\p{N}"
BREAK = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"

WORD_START = f"(?<![{WORD}])"
WORD_END = f"(?![{WORD}])"
WORD_EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

SPACE_TEXT = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
UNUSUAL_BREAK = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

LINE_BREAK = rf"\r\n|[{BREAK}]"


_SHORT = {"s": SPACE, "w": WORD, "d": r"\p{Nd}"}
# The same outside of a class, with ASCII told by a look at a table: under (?iu) each range above asks for the
# other cases of every letter it doesn't hold.
_QUICK = {
    "s": r"\p{Space}\x1c\x1d\x1e\x1f[\P{ASCII}&&[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]",
    "w": r"\p{Alnum}_[\P{ASCII}&&[" + "\U0001d400" + r"\p{L}\p{N}]]",
    "d": r"\p{Nd}",
}
_QUICK_START, _QUICK_END = f"(?<![{_QUICK['w']}])", f"(?![{_QUICK['w']}])"
_QUICK_EDGE = f"(?:(?<=[{_QUICK['w']}]){_QUICK_END}|{_QUICK_START}(?=[{_QUICK['w']}]))"
_SAME = set("AnrtfaBb0123456789xuU")
_CODES = {"x": 2, "u": 4, "U": 8}
_LATIN = set("àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")


class _Translation:
    """Rewrites one pattern, token by token, so that Java reads it as Python does."""

    def __init__(self, pattern: str):
        self.text, self.at, self.out = pattern, 0, []
        self.after_word = False  # whether what was read last is a plain ASCII letter or digit, once
        self.names: dict[str, str] = {}

    def fail(self, what: str):
        raise ValueError(f"{what} can't be used in a rule: {self.text!r}")

    def take(self, n: int = 1) -> str:
        part = self.text[self.at:self.at + n]
        self.at += n
        return part

    def name(self) -> str:
        end = self.text.index(")" if self.text[self.at - 1] == "=" else ">", self.at)
        name = self.take(end - self.at)
        self.at += 1
        return self.names.setdefault(name, f"g{len(self.names)}")

    def code(self, letter: str) -> str:
        return "\\x{" + self.take(_CODES[letter]) + "}"

    def before_word(self) -> bool:
        """Whether a plain ASCII letter, digit or underscore must follow, whose case changes nothing of that."""
        return bool(re.match(r"[0-9A-Za-z_](?![*?{])", self.text[self.at:]))

    def edge(self, after_word: bool) -> str:
        """The edge of a word; beside a plain letter one look is enough."""
        if after_word and not self.before_word():
            return _QUICK_END
        return _QUICK_START if self.before_word() and not after_word else _QUICK_EDGE

    def escape(self, after_word: bool) -> str:
        c = self.take()
        if c.lower() in _SHORT:
            return f"[{'^' * c.isupper()}{_QUICK[c.lower()]}]"
        edges = {"b": self.edge(after_word), "B": f"(?!{_QUICK_EDGE})", "Z": r"\z", "v": r"\x0b"}
        if c in edges:
            return edges[c]
        if c in _CODES:
            return self.code(c)
        if c.isalpha() and c not in _SAME:
            self.fail(f"\\{c}")
        if c == "0":
            self.fail("an octal number")
        if c.isdigit():  # of a group; the next letter is no plain one
            c += self.take(len(re.match(r"\d*", self.text[self.at:])[0]))
        return "\\" + c

    def group(self) -> str:
        if self.text.startswith("(?P<", self.at):
            self.at += 4
            return f"(?<{self.name()}>"
        if self.text.startswith("(?P=", self.at):
            self.at += 4
            return f"\\k<{self.name()}>"
        if self.text.startswith(("(?:", "(?=", "(?!", "(?>"), self.at):
            return self.take(3)
        if self.text.startswith(("(?<=", "(?<!"), self.at):
            return self.take(4)
        if self.text.startswith("(?", self.at):
            self.fail(self.text[self.at:self.at + 3] + "...)")
        return self.take()

    def members(self) -> str:
        """A class; shorthands for what is not in a class become alternatives to it."""
        self.at += 1
        negated = self.text[self.at] == "^"
        self.at += negated
        own, others, first = [], [], True
        while first or self.text[self.at] != "]":
            c, first = self.take(), False
            if c != "\\":
                own.append("\\" + c if c in "[]&^" else c)
                continue
            c = self.take()
            if c in _SHORT:
                own.append(_SHORT[c])
            elif c.lower() in _SHORT:
                others.append(f"[^{_SHORT[c.lower()]}]")
            elif c in _CODES:
                own.append(self.code(c))
            elif c in "bv":
                own.append({"b": r"\x08", "v": r"\x0b"}[c])
            elif c.isalnum() and c not in "nrtfa":
                self.fail(f"\\{c} in a class")
            else:
                own.append("\\" + c)
        self.at += 1
        inside = "".join(own)
        if not others:
            return f"[{'^' * negated}{inside}]"
        either = "|".join([*([f"[{inside}]"] if inside else []), *others])
        return f"(?:(?!{either})[\\x{{0}}-\\x{{10FFFF}}])" if negated else f"(?:{either})"

    def run(self) -> str:
        while self.at < len(self.text):
            c = self.text[self.at]
            after_word, self.after_word = self.after_word, False
            if c == "\\":
                self.at += 1
                self.out.append(self.escape(after_word))
            elif c == "[":
                self.out.append(self.members())
            elif c == "(":
                self.out.append(self.group())
            elif c == "^":  # also at the very end of a text, unlike Java's
                self.at += 1
                self.out.append(r"(?:^|(?:(?<=\n)|\A)\z)")
            elif c == "{":
                bounds = re.match(r"\{(\d*)(,?)(\d*)\}", self.text[self.at:])
                if bounds and (bounds[1] or bounds[3]):
                    self.at += bounds.end()
                    self.out.append("{" + (bounds[1] or "0") + bounds[2] + bounds[3] + "}")
                else:
                    self.at += 1
                    self.out.append(r"\{")
            else:
                self.out.append(("\\" if c == "}" else "") + self.take())
                self.after_word = c.isascii() and (c.isalnum() or c == "_")
        return "".join(self.out)


def java_pattern(pattern: str) -> str:
    """A rule pattern in Java syntax: any case, ``^`` and ``$`` at each ``\n``, Unicode classes.

    What Java can't be made to read the same way is refused: octal numbers, names of characters,
    conditions, comments and flags. A back-reference to a letter beyond U+FFFF finds nothing there.
    """
    re.compile(pattern, re.IGNORECASE | re.MULTILINE)
    return "(?imdu)" + _Translation(pattern).run()


def needles_hold(pattern: str, needles: tuple[str, ...]) -> bool:
    """Whether it can be shown that every match of a valid pattern holds one of the needles.

    Each alternative must have one in a run of plain characters that is neither optional nor in a
    look-around. Knowing less than it could, this errs towards no.
    """
    def atom(at: int) -> tuple[str, bool, int]:
        """(plain character or nothing, whether it surely holds a needle, where it ends)."""
        c = pattern[at]
        if c == "(":
            ahead = re.match(r"\(\?(?:P<\w+>|P=\w+|<?[=!]|[:>])|\(", pattern[at:])[0]
            held, end = sequence(at + len(ahead))
            return "", held and ahead[-1] not in "=!" and not ahead.startswith("(?P="), end + 1
        if c == "[":
            return "", False, at + re.match(r"\[\^?\]?(?:\\.|[^\]\\])*\]", pattern[at:]).end()
        if c == "\\":
            follows = pattern[at + 1]
            size = 2 + _CODES.get(follows, 0)
            return "" if follows.isalnum() else follows, False, at + size
        return "" if c in ".^$" else c, False, at + 1

    def sequence(at: int) -> tuple[bool, int]:
        every, held, run = True, False, ""
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                every, held, run, at = every and held, False, "", at + 1
                continue
            plain, surely, at = atom(at)
            times = re.match(r"([*?]|\{0?,\d*\}|\{0(?:,\d*)?\})?(\+|\{\d+(?:,\d*)?\})?[?+]?", pattern[at:])
            at += times.end()
            if times[1]:
                plain, surely = "", False
            run = run + plain.lower() if plain else ""
            held = held or surely or any(n in run for n in needles)
            if times[0]:
                run = ""
        return every and held, at
    return sequence(0)[0]


def sure_needles(pattern: str) -> tuple[str, ...]:
    """Lower-case strings of which every match of a valid pattern holds one; none if that can't be shown.

    The longest run of plain characters of each alternative is taken, as far as ``needles_hold`` shows it.
    Letters of other scripts are left out, as ``fold_case`` need not fold them as a pattern does.
    """
    parts, runs, depth = [""], [[""]], 0
    for token in re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", pattern, re.DOTALL):
        if token == "|" and not depth:
            parts.append("")
            runs.append([""])
            continue
        depth += (token == "(") - (token == ")")
        parts[-1] += token
        plain = token[-1] if token[0] == "\\" and not token[-1].isalnum() else token
        if len(plain) == 1 and (plain != token or plain not in ".^$*+?{}[]()|\\") and (plain.isascii() or plain in _LATIN):
            runs[-1][-1] += plain.lower()
        else:
            if token in "*?{":
                runs[-1][-1] = runs[-1][-1][:-1]
            runs[-1].append("")
    held = [next((r for r in sorted(of, key=len, reverse=True) if (len(r) > 1 or r and r in _LATIN) and needles_hold(part, (r,))), "")
            for part, of in zip(parts, runs, strict=True)]
    return tuple(dict.fromkeys(held)) if all(held) and needles_hold(pattern, tuple(held)) else ()


def fold_case(text: Column) -> Column:
    """Lower case, with the four letters that match an ASCII letter only when case is ignored."""
    odd = "\u0130\u0131\u017f\u212a"
    has_odd = F.contains(text, F.lit(odd[0]))
    for letter in odd[1:]:
        has_odd = has_odd | F.contains(text, F.lit(letter))
    return F.lower(F.when(has_odd, F.translate(text, odd, "iisk")).otherwise(text))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE_TEXT))


def split_lines(text: Column) -> Column:
    """The lines of a text, at every line break; no empty last line after a final break."""
    lines = F.when(text.rlike(UNUSUAL_BREAK), F.split(text, LINE_BREAK)).otherwise(
        F.split(text, "\n"))
    return F.when(F.endswith(text, F.lit("\n")) | text.rlike(rf"{UNUSUAL_BREAK}\z")
                  | (F.length(text) == 0),
                  F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def count_lines(lines: Column, keep) -> Column:
    return F.size(F.filter(lines, keep)).cast("long")


def code_line_count(lines: Column) -> Column:
    """Lines with something on them."""
    return count_lines(lines, lambda line: line.rlike(rf"[^{SPACE}]"))


def comment_line_count(lines: Column) -> Column:
    """Lines that begin with a comment sign of any supported language."""
    return count_lines(lines, lambda line: line.rlike(rf"\A[{SPACE}]*+(?:#|//|/?\*)"))


def long_line_count(lines: Column, limit: int) -> Column:
    return count_lines(lines, lambda line: F.length(line) > limit)
