"""LaTeX to prose: one walk over the tokens of a source, with its groups and environments on a stack."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Environments without prose; commands whose argument is no prose; commands whose argument stands alone.
DROPPED = frozenset("figure figure* table table* equation equation* align align* thebibliography lstlisting verbatim".split())
POINTERS = frozenset("ref eqref label url href".split())
APART = frozenset("section subsection subsubsection paragraph textbf textit emph textrm texttt caption".split())
TOKEN = re.compile(r"%[^\n]*|\\[A-Za-z@]+\*?|\\.|\$\$?|[{}]|[^\\%${}]+|\\", re.S)
CLOSING = {"$": "$", "$$": "$$", "\\(": "\\)", "\\[": "\\]"}
BREAK = "\n\n"


class Walk:
    """Reads a source once; ``out`` holds what it has said so far."""

    def __init__(self, source: str):
        self.tokens, self.at = TOKEN.findall(source), 0
        self.out: list[str] = []
        self.ends: list[str] = []  # what the end of each open group says

    def prose(self) -> str:
        while self.at < len(self.tokens):
            token = self.tokens[self.at]
            self.at += 1
            if token in CLOSING:
                self.to(CLOSING[token])
                self.out.append(" ")
            elif token == "{":
                self.open(" ")
            elif token == "}":
                self.out.append(self.ends.pop() if self.ends else " ")
            elif token.startswith("%"):
                self.out.append(" ")
            elif token.startswith("\\") and token[1:2].isalpha() or token.startswith("\\@"):
                if self.command(token[1:].rstrip("*")):
                    break
            elif token.startswith("\\"):
                self.out.append("&" if token == "\\&" else " ")
            else:
                self.out.append(token.replace("~", " "))
        return "".join(self.out)

    def command(self, name: str) -> bool:
        """What a command says; true where the document ends."""
        if name in ("begin", "end"):
            environment = self.group()
            if environment == "document":
                if name == "end":
                    return True
                self.out.clear()
            elif name == "begin" and environment in DROPPED:
                self.leave(environment)
            self.out.append(BREAK)
            return False
        self.options()
        if name in POINTERS or name.startswith("cite"):
            self.group()
            self.out.append(" ")
        elif self.next() == "{":
            self.at += 1
            self.open(BREAK if name in APART else " ")
        else:
            self.out.append(" ")
        return False

    def open(self, sound: str) -> None:
        self.out.append(sound)
        self.ends.append(sound)

    def next(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def options(self) -> None:
        """Skip ``[...]``; text after it goes on as a token of its own."""
        text = self.next()
        if text.lstrip().startswith("[") and "]" in text:
            rest = text[text.index("]") + 1 :]
            if rest.strip():
                self.tokens[self.at] = rest
            else:
                self.at += 1

    def group(self) -> str:
        """Skip a group in braces, groups inside it too, and return what it holds."""
        if not self.next().strip():
            self.at += 1
        if self.next() != "{":
            return ""
        start, depth = self.at + 1, 0
        while self.at < len(self.tokens):
            depth += {"{": 1, "}": -1}.get(self.tokens[self.at], 0)
            self.at += 1
            if not depth:
                break
        return "".join(self.tokens[start : self.at - 1])

    def to(self, closing: str) -> None:
        """Skip to a token and over it; what is never closed is left as it stands."""
        try:
            self.at = self.tokens.index(closing, self.at) + 1
        except ValueError:
            pass

    def leave(self, environment: str) -> None:
        """Skip an environment and those of its name inside it."""
        depth = 1
        while depth and self.at < len(self.tokens):
            token = self.tokens[self.at]
            self.at += 1
            if token in ("\\begin", "\\end") and self.group() == environment:
                depth += 1 if token == "\\begin" else -1


def prose(source: str) -> str:
    return Walk(source).prose()


@F.arrow_udf(T.StringType())
def _prose(source: pa.Array) -> pa.Array:
    return pa.array([None if s is None else prose(s) for s in source.to_pylist()], pa.string())


def latex_prose(source: Column) -> Column:
    """Prose of a LaTeX document: comments, floats, maths and references out, commands unwrapped; not yet cleaned."""
    return _prose(source)
