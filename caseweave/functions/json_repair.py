"""Repair of JSON that a model wrote: cut answers, stray and missing marks, loose quotes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

GAP = re.compile(r"(?:\s|//[^\n]*|/\*.*?(?:\*/|\Z)|\ufeff)*", re.S)
BARE = re.compile(r"[^\s,:{}\[\]\"'“”]+(?:[^\S\n]+[^\s,:{}\[\]\"'“”]+)*")
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
FENCE = re.compile(r"```\w*\s*")
#: What may close a string that begins with a mark.
CLOSING = {'"': '"', "'": "'", "“": '”"', "”": '”"'}
#: Words for constants, in lower case.
WORDS = {"true": "true", "false": "false", "null": "null", "none": "null", "undefined": "null", "nan": "null", "infinity": "null", "-infinity": "null"}


class Scanner:
    """Reads loose JSON once, from left to right, with a stack of what is open, and writes strict JSON."""

    def __init__(self, text: str, at: int) -> None:
        self.text, self.at, self.out = text, at, []
        #: Open brackets, each with how many members it has and what an object waits for: a key, a colon or a value.
        self.open: list[list] = []

    def gap(self) -> str:
        """Pass white space and comments; the character after it, or nothing at the end."""
        self.at = GAP.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def string(self, mark: str, key: bool) -> str:
        """The string that begins at the mark here, as strict JSON; cut escapes are dropped, loose quotes inside a value kept."""
        text, out, at = self.text, ['"'], self.at + 1
        while at < len(text):
            c = text[at]
            if c == "\\":
                m = re.compile(r"\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4})").match(text, at)
                if m:
                    out.append(m[0])
                elif text[at + 1 : at + 2] == "u" or at + 1 == len(text):
                    at = len(text) if re.fullmatch(r"\\(?:u[0-9a-fA-F]{0,3})?", text[at:]) else at + 1
                    continue
                else:
                    out.append(json.dumps(text[at + 1])[1:-1])
                at += len(m[0]) if m else 2
            elif c in CLOSING[mark] and (key or self._ends(at + 1)):
                at += 1
                break
            else:
                out.append('\\"' if c == '"' else c if c >= " " else json.dumps(c)[1:-1])
                at += 1
        else:
            if re.fullmatch(r"\\u[dD][89abAB]..", out[-1]):
                out.pop()  # half of a pair
        self.at = at
        return "".join(out) + '"'

    def _ends(self, at: int) -> bool:
        """Whether a quote before `at` ends its string: a mark of structure, another string or nothing follows."""
        after = self.text[GAP.match(self.text, at).end() :][:1]
        return after in ("", ",", ":", "}", "]", '"', "'", "“")

    def bare(self) -> str:
        """A number, constant or word without quotes."""
        m = BARE.match(self.text, self.at)
        if not m:  # a mark that has no meaning here
            self.at += 1
            return ""
        word, self.at = m[0], m.end()
        if NUMBER.fullmatch(word):
            return word
        if word.lower() in WORDS:
            return WORDS[word.lower()]
        if self.at == len(self.text):  # a cut number or constant
            if (n := NUMBER.match(word)) and re.fullmatch(r"[.eE+-]*", word[n.end() :]):
                return n[0]
            if word == "-":
                return "null"
            for known in ("true", "false", "null"):
                if known.startswith(word):
                    return known
        return json.dumps(word)

    def put(self, value: str) -> None:
        """Write a value, or a key where one is due, in the innermost bracket."""
        if not self.open:
            self.out.append(value)
            return
        frame = self.open[-1]
        if frame[0] == "[" or frame[2] == "key":
            self.out.append("," if frame[1] else "")
            frame[1] += 1
        self.out.append(value)
        if frame[0] == "{":
            frame[2] = {"key": "colon", "value": "key"}[frame[2]]

    def value(self) -> None:
        """Write what an object owes after a key that has no value."""
        frame = self.open[-1]
        if frame[0] == "{" and frame[2] != "key":
            self.out.append(":null" if frame[2] == "colon" else "null")
            frame[2] = "key"

    def close(self) -> None:
        self.value()
        self.out.append("}" if self.open.pop()[0] == "{" else "]")

    def run(self) -> str:
        while (c := self.gap()) and (self.open or not self.out):
            frame = self.open[-1] if self.open else ["", 0, ""]
            if c in "}]":
                self.at += 1
                wanted = "{" if c == "}" else "["
                if any(f[0] == wanted for f in self.open):
                    while self.open[-1][0] != wanted:
                        self.close()
                    self.close()
            elif c == "," or c == ":":
                self.at += 1
                if c == ":" and frame[2] == "colon":
                    self.out.append(":")
                    frame[2] = "value"
                elif c == "," and self.open:
                    self.value()
            elif frame[2] == "colon":  # the colon is missing
                self.out.append(":")
                frame[2] = "value"
            elif c in "{[":
                if frame[2] == "key":  # no key can begin so: the object's end is missing
                    self.close()
                    if not self.open:
                        break
                    continue
                self.at += 1
                self.put(c)
                self.open.append([c, 0, "key" if c == "{" else ""])
            elif c in CLOSING:
                self.put(self.string(c, frame[2] == "key"))
            elif word := self.bare():
                self.put(word if frame[2] != "key" or word[0] == '"' else json.dumps(word))
        while self.open:
            self.close()
        return "".join(self.out)


def repaired(text: str | None) -> str | None:
    """Strict JSON for what a model wrote as JSON; null for null and for a text without a bracket.

    The value is the text itself if it begins with a bracket, else what follows a code fence, else the first object or
    list in it; what stands behind it is passed over. Cut texts keep all that was whole, and what was read of the rest. Time is linear but for strings full of quotes.
    """
    if text is None:
        return None
    start = GAP.match(text, 0).end()
    if text[start : start + 1] not in ("{", "["):
        fence = FENCE.search(text)
        start = GAP.match(text, fence.end()).end() if fence else start
        if text[start : start + 1] not in ("{", "["):
            start = text.find("{") if "{" in text else text.find("[")
    return Scanner(text, start).run() if start >= 0 else None


@F.pandas_udf(StringType())
def _repair(texts: pd.Series) -> pd.Series:
    return texts.map(repaired, na_action="ignore")


def repaired_json(raw: Column) -> Column:
    """The text itself where it is JSON, else repaired; only broken texts go to Python, batch by batch."""
    fine = F.try_parse_json(raw).isNotNull()
    return F.when(fine, raw).otherwise(_repair(F.when(~fine, raw)))
