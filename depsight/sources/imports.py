"""Import statements of JavaScript and TypeScript files.

A scanner cuts a file into tokens: it knows regular expressions from divisions by what stands before them, follows templates and their insertions, and in
files with JSX reads tags, attributes and text. Statements are then recognised by their tokens. A file whose strings, comments, templates, brackets or tags
have no end, or whose import has no source, is a parse error and has no statements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsight.tables import packed

FIELDS = "file_id string, ordinal int, source string, kind string, is_template boolean, is_unresolvable boolean"
#: Rows of statements from which a frame goes back to Spark: a batch of files can hold a hundred times as many as it has files.
MOST = 20_000
#: Extensions with types and with JSX; all others are plain scripts, where a tag is an error.
TYPED, TAGGED = ("ts", "tsx"), ("tsx", "jsx")
SPACE = re.compile(r"(?:\s|//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)++")
TOKEN = re.compile(
    r"""(?P<string>'(?:[^'\\\n]|\\[\s\S])*+'|"(?:[^"\\\n]|\\[\s\S])*+")|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\.?\d[\w.]*)|(?P<punct>=>|\+\+|--|\?\.(?!\d)|\.\.\.|[^\w\s])"""
)
REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/\w*")
QUASI = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(`|\$\{)")
TAG = re.compile(r"<\s*(?:>|([A-Za-z_$][\w$.:-]*))")
GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b|=)")
#: Parentheses within parentheses go three deep here.
PARENTHESES = re.compile(r"\s*>\s*\((?:[^()]|\((?:[^()]|\([^()]*+\))*+\))*+\)\s*(=>|:)")
ATTRIBUTE = re.compile(r"""\s++|//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|[\w$.:=@-]+|"[^"]*"|'[^']*'""")
#: Words after which an expression begins, and words whose parentheses are followed by a statement.
BEFORE_EXPRESSION = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
BEFORE_STATEMENT = frozenset(("if", "while", "for", "with"))
STATEMENT_WORDS = frozenset("const let var import export function class interface type enum if for while return async declare abstract namespace".split())
TYPE_WORDS = frozenset("typeof as satisfies extends implements keyof is infer".split())
#: An import declaration on a line of its own, spelt plainly and ended by a semicolon: behind it a file is read as from its beginning.
HEAD = re.compile(r"""import (?:(?:[A-Za-z_]\w*|\* as [A-Za-z_]\w*|\{[\w ,]*\}) from )?(?:'([^'\\\n]*)'|"([^"\\\n]*)");(?:\n|\Z)""")
CLOSES = {")": "(", "]": "[", "}": "{"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


class Token:
    __slots__ = ("kind", "text", "depth", "line_start")

    def __init__(self, kind: str, text: str, depth: int, line_start: bool):
        self.kind, self.text, self.depth, self.line_start = kind, text, depth, line_start


def cooked(body: str) -> str:
    """What the body of a string or template stands for."""
    if "\\" not in body:
        return body
    code = lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else "" if m[4] in "\n\r\u2028\u2029" else ESCAPES.get(m[4], m[4])
    return re.sub(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|u\{([0-9a-fA-F]{1,5})\}|([\s\S]))", code, body)


class Scanner:
    """The tokens of a file. Open brackets, templates, tags and elements are kept on a stack of (what, detail)."""

    def __init__(self, text: str, extension: str, at: int = 0):
        self.text, self.at, self.end = text, at, len(text)
        self.typed, self.tagged = extension in TYPED, extension in TAGGED
        self.tokens: list[Token] = []
        self.stack: list[tuple[str, object]] = []
        self.operand = False  # whether what was read last ends an expression
        self.line_start = True

    def put(self, kind: str, text: str, operand: bool) -> None:
        self.tokens.append(Token(kind, text, len(self.stack), self.line_start))
        self.operand, self.line_start = operand, False

    def last(self) -> str:
        return self.tokens[-1].text if self.tokens else ";"

    def run(self) -> list[Token]:
        if not self.at and self.text.startswith("#!"):
            self.at = (self.text + "\n").index("\n")
        while self.at < self.end:
            mode = self.stack[-1][0] if self.stack else ""
            if mode == "element":
                self.child()
            elif mode == "tag":
                self.attribute()
            else:
                self.script()
        if self.stack:
            raise ValueError(f"no end of {self.stack[-1][0]}")
        return self.tokens

    def script(self) -> None:
        text, at = self.text, self.at
        if m := SPACE.match(text, at):
            self.at, self.line_start = m.end(), self.line_start or "\n" in m[0]
            return
        c = text[at]
        if c == "/" and text.startswith("/*", at):
            raise ValueError("no end of a comment")
        if c == "/" and not self.operand and (m := REGEX.match(text, at)):
            self.at = m.end()
            return self.put("regex", m[0], True)
        if c == "`":
            self.at += 1
            return self.quasi("template")
        if c == "<" and not self.operand and self.is_tag():
            if not self.tagged:
                raise ValueError("a tag in a file without them")
            return self.tag()
        m = TOKEN.match(text, at)
        if not m or m[0] in "'\"":
            raise ValueError("no end of a string")
        self.at, word, kind = m.end(), m[0], m.lastgroup
        if kind == "name":
            plain = word not in BEFORE_EXPRESSION or (word == "of" and self.stack[-1:] != [("(", True)])  # of is a word in the parentheses of a loop only
            self.put(kind, word, plain or self.last() in (".", "?."))
        elif kind != "punct":
            self.put(kind, word, True)
        elif word in "([{":
            before = self.last()
            plain = not self.operand and before not in (";", "{", "}", "=>", "else", "do", ")") and not (before == ":" and self.is_case())
            detail = before in BEFORE_STATEMENT if word == "(" else plain  # parentheses of a statement; braces of an object
            self.put(kind, word, False)
            self.stack.append((word, detail))
        elif word in CLOSES:
            self.close(word)
        elif word in ("++", "--"):
            self.put(kind, word, self.operand)
        elif word == "!" and self.operand and not self.line_start:
            self.put(kind, word, self.typed and text[self.at : self.at + 1] != "=")
        else:
            self.put(kind, word, False)

    def close(self, word: str) -> None:
        what, detail = self.stack.pop() if self.stack else ("", None)
        if word == "}" and what == "insertion":
            return self.quasi("quasi")
        if word == "}" and what == "braces":  # back in a tag or an element
            return None
        if what != CLOSES[word]:
            raise ValueError("brackets don't match")
        self.put("punct", word, {")": not detail, "]": True, "}": bool(detail)}[word])
        return None

    def quasi(self, kind: str) -> None:
        m = QUASI.match(self.text, self.at)
        if not m:
            raise ValueError("no end of a template")
        body, open_ = self.text[self.at : m.start(1)], m[1] == "${"
        self.at = m.end()
        self.put(kind + (" open" if open_ else ""), body, not open_)
        if open_:
            self.stack.append(("insertion", None))

    def is_case(self) -> bool:
        """Whether the colon that was read last ends a label of a switch."""
        for t in reversed(self.tokens[:-1]):
            if t.depth < len(self.stack) or t.text in (";", "?"):
                return False
            if t.depth == len(self.stack) and t.text in ("case", "default"):
                return True
        return False

    # tags

    def is_signature(self, at: int) -> bool:
        """Whether a name's > at this place ends a list of type parameters: parentheses follow, and behind them an arrow or, in a type's body, a colon."""
        m = PARENTHESES.match(self.text, at)
        return bool(m) and (m[1] == "=>" or self.last() in ("{", "}", ";", ","))

    def is_tag(self) -> bool:
        m = TAG.match(self.text, self.at)
        if not m or (self.typed and (GENERIC.match(self.text, self.at) or not self.tagged or (m[1] and self.is_signature(m.end())))):
            return False
        rest = self.text.find(f"</{m[1] or '>'}", m.end()) >= 0
        return rest or self.text.find("/>", m.end()) >= 0

    def tag(self) -> None:
        m = TAG.match(self.text, self.at)
        self.at = m.end()
        if m[1] and self.text.startswith("<", self.at):  # type arguments of a tag
            deep = 0
            while self.at < self.end:
                c = self.text[self.at]
                deep += (c == "<") - (c == ">" and self.text[self.at - 1] != "=")
                self.at += 1
                if not deep:
                    break
        self.stack.append(("tag" if m[1] else "element", m[1] or ""))

    def attribute(self) -> None:
        text = self.text
        if m := ATTRIBUTE.match(text, self.at):
            self.at = m.end()
        elif text.startswith("/>", self.at):
            self.at += 2
            self.stack.pop()
            self.done()
        elif text[self.at] == ">":
            self.at += 1
            self.stack.append(("element", self.stack.pop()[1]))
        elif text[self.at] == "{":
            self.braces()
        elif text[self.at] == "<":
            self.tag()
        else:
            raise ValueError("a tag can't be read")

    def child(self) -> None:
        m = re.compile(r"[^<{]*+").match(self.text, self.at)
        self.at = m.end()
        if self.at >= self.end:
            raise ValueError("no end of an element")
        if self.text[self.at] == "{":
            return self.braces()
        if m := re.compile(r"<\s*/\s*([\w$.:-]*)\s*>").match(self.text, self.at):
            if m[1] != self.stack.pop()[1]:
                raise ValueError("tags don't match")
            self.at = m.end()
            return self.done()
        if not TAG.match(self.text, self.at):
            raise ValueError("a tag can't be read")
        return self.tag()

    def braces(self) -> None:
        self.at += 1
        self.stack.append(("braces", None))
        self.operand = False
        self.tokens.append(Token("punct", "(", len(self.stack), False))  # what follows begins an expression

    def done(self) -> None:
        if not self.stack or self.stack[-1][0] not in ("tag", "element"):
            self.put("tag", "", True)


def head(text: str) -> tuple[list[str], int]:
    """The sources of the plain import declarations that a file begins with, and where its tokens are to be read from: with the last of these, where more follows."""
    sources, last, at = [], 0, 0
    while m := HEAD.match(text, at):
        sources.append(m[1] if m[2] is None else m[2])
        last, at = at, m.end()
    if at < len(text) and sources:
        return sources[:-1], last
    return sources, at


def statements(text: str, extension: str = "ts") -> list[tuple[str, str, bool, bool]]:
    """(source, kind, is_template, is_unresolvable) of a file: declarations first, then calls; ValueError if it can't be read."""
    sources, at = head(text)
    declared, called, alias = [(x, "static", False, False) for x in sources if x], [], None
    tokens = Scanner(text, extension, at).run() if at < len(text) else []
    for i, t in enumerate(tokens):
        if alias is not None and (t.depth < alias or (t.depth == alias and (t.text == ";" or (t.line_start and t.kind == "name" and t.text in STATEMENT_WORDS)))):
            alias = None
        if t.kind != "name":
            continue
        before, after = tokens[i - 1].text if i else ";", tokens[i + 1].text if i + 1 < len(tokens) else ""
        if before in (".", "?.", "#"):
            continue
        if t.text == "type" and before in (";", "}", "{", "export", "declare") or t.text == "type" and t.line_start:
            alias = t.depth if re.fullmatch(r"[\w$]+", after) and i + 2 < len(tokens) and tokens[i + 2].text in ("=", "<") else alias
        elif t.text == "require" and after == "(" and before not in ("new", "function"):
            assigned = before == "=" and any(x.text == "import" and x.depth == t.depth for x in tokens[max(0, i - 4) : i])
            if literal(tokens, i + 2) and not assigned:
                called.append((cooked(tokens[i + 2].text[1:-1]), "require", False, False))
        elif t.text == "import" and after == "(":
            if not (alias is not None or before in TYPE_WORDS or in_types(tokens, i, before)):
                called.append(dynamic(tokens, i + 2))
        elif t.text == "import" and t.depth == 0 and after != ".":
            if source := declaration(tokens, i):
                declared.append((source, "static", False, False))
        elif t.text == "export" and t.depth == 0:
            k = i + 2 if after == "type" else i + 1
            if k < len(tokens) and tokens[k].text in ("*", "{") and (source := exported(tokens, k)):
                declared.append((source, "reexport", False, False))
    return declared + called


def literal(tokens: list[Token], k: int) -> bool:
    """Whether the argument at token k is a string and nothing more."""
    return k + 1 < len(tokens) and tokens[k].kind == "string" and tokens[k + 1].text in (",", ")")


def closing(tokens: list[Token], k: int) -> int:
    """The place of the bracket that closes the one at token k."""
    return next((j for j in range(k + 1, len(tokens)) if tokens[j].depth == tokens[k].depth and tokens[j].text in CLOSES), len(tokens))


def in_types(tokens: list[Token], i: int, before: str) -> bool:
    """Whether import( at token i is a type or a method's name: what follows its parenthesis tells."""
    k = closing(tokens, i + 1)
    after = [t.text for t in tokens[k + 1 : k + 3]] + ["", ""]
    if after[0] == ".":
        return after[1] not in ("then", "catch", "finally")
    if before == ":" and i > 2 and tokens[i - 2].kind == "name" and tokens[i - 3].text in ("let", "const", "var"):
        return True
    named = before in ("{", "}", ";", ",", "async", "static", "public", "private", "protected", "abstract", "get", "set", "*")
    return named and tokens[i].depth > 0 and (after[0] == "{" or (after[0] == ":" and before != ","))


def dynamic(tokens: list[Token], k: int) -> tuple[str, str, bool, bool]:
    t = tokens[k] if k < len(tokens) else Token("punct", "", 0, False)
    if literal(tokens, k):
        return cooked(t.text[1:-1]), "dynamic", False, False
    if t.kind == "template" and k + 1 < len(tokens) and tokens[k + 1].text in (",", ")"):
        return cooked(t.text), "dynamic", False, False
    if t.kind == "template open":
        j = next((j for j in range(k + 1, len(tokens)) if tokens[j].kind == "quasi" and tokens[j].depth == t.depth), len(tokens))
        if j + 1 < len(tokens) and tokens[j + 1].text in (",", ")"):
            return cooked(t.text), "dynamic", True, not t.text
    return "", "dynamic", False, True


def declaration(tokens: list[Token], i: int) -> str | None:
    """The source of the import declaration at token i; none for a TypeScript assignment."""
    for k in range(i + 1, len(tokens)):
        t = tokens[k]
        if t.depth == 0 and t.kind == "string" and (k == i + 1 or tokens[k - 1].text == "from"):
            return cooked(t.text[1:-1])
        if t.depth == 0 and t.text == "=":
            return None
        if t.depth == 0 and (t.text in (";", "(") or (t.kind == "name" and k > i + 1 and t.line_start and t.text in STATEMENT_WORDS - {"type"})):
            break
    raise ValueError("an import without a source")


def exported(tokens: list[Token], k: int) -> str | None:
    """The source of an export list or star that begins at token k."""
    k = closing(tokens, k) + 1 if tokens[k].text == "{" else k + 1
    if k + 1 < len(tokens) and tokens[k].text == "as":
        k += 2
    if k + 1 < len(tokens) and tokens[k].text == "from" and tokens[k + 1].kind == "string":
        return cooked(tokens[k + 1].text[1:-1])
    return None


def parsed(batches: Iterator[pd.DataFrame], most: int = MOST) -> Iterator[pd.DataFrame]:
    """FIELDS of the statements and errors of (path, content) batches, in frames that end with the file that brings them to most rows."""
    frame = lambda rows: pd.DataFrame(rows, columns=["file_id", "ordinal", "source", "kind", "is_template", "is_unresolvable"])
    for b in batches:
        rows = []
        for path, text in zip(b["path"], b["content"], strict=True):
            if text is None or text != text:
                rows.append((path, -1, "not UTF-8 or gone", "read_file", False, False))
                continue
            try:
                rows += [(path, k, *s) for k, s in enumerate(statements(text, path.rpartition(".")[2]))]
            except ValueError as e:
                rows.append((path, -1, str(e), "parse_file", False, False))
            if len(rows) >= most:
                yield frame(rows)
                rows = []
        yield frame(rows)


def imports(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Import statements, and errors (kind, path, message), of (path, content) rows. A file that can't be read or parsed has no imports and one error."""
    found = packed(files.select("path", "content").mapInPandas(lambda batches: parsed(batches), FIELDS), "imports")
    return found.where("ordinal >= 0"), found.where("ordinal < 0").select("kind", F.col("file_id").alias("path"), F.col("source").alias("message"))
