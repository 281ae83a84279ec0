"""Symbols of languages with braces: one pass over a text's tokens that skips comments and strings, pairs
brackets and reads definitions off their shape. What encloses what is left to expressions over the
rows (see parsing.py)."""

from __future__ import annotations

import re

#: Comments, texts (also raw and template ones, characters), words, numbers, and all other marks.
_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_TEXT = r'"(?:\\.|[^"\\\n])*"?'
_TOKENS = {
    "c": rf"(?P<skip>{_COMMENT})|(?P<text>R\"(?P<tag>[^()\s\\]*)\(.*?\)(?P=tag)\"|{_TEXT}|'(?:\\.|[^'\\\n])*'?)",
    "java": rf"(?P<skip>{_COMMENT})|(?P<text>\"\"\".*?(?:\"\"\"|\Z)|{_TEXT}|'(?:\\.|[^'\\\n])*'?)",
    "go": rf"(?P<skip>{_COMMENT})|(?P<text>{_TEXT}|`[^`]*`?|'(?:\\.|[^'\\\n])*'?)",
    "javascript": rf"(?P<skip>{_COMMENT})|(?P<text>{_TEXT}|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)",
    "rust": rf"(?P<skip>{_COMMENT})|(?P<text>b?r(?P<tag>\#*)\".*?\"(?P=tag)|{_TEXT}|'(?:\\[^\n]|[^'\\\n])[^'\n]{{0,8}}?'(?!\w))",
}
_REST = r"|(?P<word>[A-Za-z_$\u0080-\U0010FFFF][\w$]*)|(?P<number>\d[\w.]*)|(?P<line>^[ \t]*\#(?:\\\n|[^\n])*)|(?P<mark>->|=>|::|:=|[^\s\w])"
_GRAMMARS = {"c": "c", "cpp": "c", "java": "java", "go": "go", "javascript": "javascript", "typescript": "javascript", "rust": "rust"}
_LEXERS = {name: re.compile((_TOKENS[g] + _REST) if g == "c" else (_TOKENS[g] + _REST).replace(r"|(?P<line>^[ \t]*\#(?:\\\n|[^\n])*)", ""), re.S | re.M) for name, g in _GRAMMARS.items()}

#: A slash after one of these begins a regular expression.
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%<>~^") | {"=>", "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")

#: Words before a parenthesis that neither call nor define, in every language and in some.
_EVERYWHERE = "if else for while do switch case catch return throw new delete try super this import"
_OWN = {
    "c": "sizeof alignof typeof define defined",
    "cpp": "sizeof alignof decltype typeof define defined static_assert noexcept alignas operator typeid explicit throw co_await co_return",
    "java": "throws synchronized assert instanceof yield",
    "go": "func select go defer range struct interface map chan",
    "javascript": "typeof await yield in of instanceof function void async with",
    "typescript": "typeof await yield in of instanceof function void async with",
    "rust": "fn match loop move unsafe where impl in as let mut",
}
KEYWORDS = {language: frozenset(f"{_EVERYWHERE} {own}".split()) for language, own in _OWN.items()}
#: Words that may stand before a call: the word before is then no type.
_BEFORE_CALL = frozenset("return else do case throw in of and or not await yield goto co_return co_await go defer typeof delete default".split())
#: Words and marks between a function's parameters and its body.
_QUALIFIERS = frozenset("const volatile override final noexcept mutable throws throw try".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


class Symbols:
    """The functions, classes, imports and calls of a text. Lines count from 1; a function's and a class's
    first line is that of its declaration, the last that of its closing brace."""

    def __init__(self, language: str, source: str):
        self.language, self.source = language, source
        self.kind: list[str] = []
        self.value: list[str] = []
        self.at: list[int] = []
        self.line: list[int] = []
        self._read()
        self.keywords = KEYWORDS[language]
        self.pair = self._pairs()
        self.set_members: set[int] = set()  # names of members that a constructor sets before its body
        self.functions: list[dict] = []
        self.classes: list[dict] = []
        self.calls: list[dict] = []
        self.imports: list[str] = []
        self._find()

    def _read(self) -> None:
        source, position, line, counted = self.source, 0, 1, 0
        find = _LEXERS[self.language].search
        script = _GRAMMARS[self.language] == "javascript"
        kinds, values, places, lines = self.kind, self.value, self.at, self.line
        while m := find(source, position):
            kind, value = m.lastgroup, m.group()
            start, position = m.span()
            if script and value == "/" and (not values or values[-1] in _BEFORE_REGEX):
                pattern = _REGEX.match(source, start)
                if pattern:
                    position, kind, value = pattern.end(), "text", pattern.group()
            if kind == "skip":
                continue
            line += source.count("\n", counted, start)
            counted = start
            kinds.append("text" if kind == "tag" else kind)
            values.append(value)
            places.append(start)
            lines.append(line)

    def _pairs(self) -> dict[int, int]:
        """Places of brackets that belong together, both ways. A closing one without its kind is skipped; what is
        left open ends with the text."""
        pair, left = {}, []
        for i, (kind, x) in enumerate(zip(self.kind, self.value, strict=True)):
            if kind != "mark":
                continue
            if x in _OPEN:
                left.append(i)
            elif x in _CLOSE:
                if any(self.value[j] == _CLOSE[x] for j in left[-3:]):
                    while self.value[left[-1]] != _CLOSE[x]:
                        left.pop()
                    j = left.pop()
                    pair[i], pair[j] = j, i
        for j in left:
            pair[j] = len(self.value) - 1
        return pair

    def _is(self, i: int, *values: str) -> bool:
        return 0 <= i < len(self.value) and self.kind[i] != "text" and self.value[i] in values

    def _word(self, i: int) -> bool:
        return 0 <= i < len(self.kind) and self.kind[i] == "word"

    def _start(self, i: int) -> int:
        """The first token of the declaration that token i is in."""
        while i > 0 and not self._is(i - 1, ";", "{", "}", ":") and self.kind[i - 1] != "line":
            i = self.pair[i - 1] if self._is(i - 1, ")", "]") and i - 1 in self.pair else i - 1
        if self._is(i, "template") and self._is(i + 1, "<"):
            depth = 0
            while i + 1 < len(self.value):
                i += 1
                depth += self._is(i, "<") - self._is(i, ">")
                if not depth:
                    return i + 1
        return i

    def _until(self, i: int, *stops: str) -> int:
        """The first of the marks from token i on that is in no bracket; the end if none is."""
        while i < len(self.value) and not self._is(i, *stops):
            if self._is(i, *_CLOSE):
                return len(self.value)
            i = self.pair[i] + 1 if self._is(i, *_OPEN) and i in self.pair else i + 1
        return i

    def _body(self, close: int) -> int | None:
        """The brace that opens the body after a parameter list; None if there is none."""
        i = close + 1
        language = self.language
        if language == "go":
            line = self.line[close]
            while i < len(self.value):
                if self._is(i, "{") and not self._is(i - 1, "interface", "struct"):
                    return i
                if self._is(i, ";", "}") or self.line[i] > line:
                    return None
                i = self.pair[i] if self._is(i, "(", "[", "{") else i
                line = self.line[i]
                i += 1
            return None
        if language == "rust":
            i = self._until(i, "{", ";")
            return i if self._is(i, "{") else None
        if self._is(i, ":") and language == "typescript":
            i = self._until(i + 1, "{", ";", "=", ",")
            return i if self._is(i, "{") else None
        if language in ("c", "cpp", "java"):
            while self._word(i) and self.value[i] in _QUALIFIERS or self._is(i, "&", "->"):
                listed = self._is(i, "throws", "->")
                i += 1
                if listed:
                    i = self._until(i, "{", ";")
                elif self._is(i, "("):
                    i = self.pair[i] + 1
            if self._is(i, ":") and language == "cpp":
                while self._is(i, ":", ","):
                    while self._word(i + 1) or self._is(i + 1, "::"):
                        i += 1
                    if not self._is(i + 1, "(", "{"):
                        return None
                    self.set_members.add(i)
                    i = self.pair[i + 1] + 1
        return i if self._is(i, "{") else None

    def _arguments(self, opened: int) -> list[str]:
        """Texts of the parameters, cut at commas outside of brackets."""
        close, out = self.pair[opened], []
        depth, start = 0, self.at[opened] + 1
        for i in range(opened + 1, close + 1):
            if self.kind[i] == "mark":
                depth += (self.value[i] in "([{<") - (self.value[i] in ")]}>")
                if i == close or self.value[i] == "," and depth <= 0:
                    out.append(" ".join(self.source[start : self.at[i]].split()))
                    start = self.at[i] + 1
        return [x for x in out if x]

    def _find(self) -> None:
        kinds = {"c": ("struct",), "cpp": ("class", "struct"), "java": ("class", "interface"), "go": ("type",), "rust": ("struct", "trait")}.get(self.language, ("class",))
        bodies: dict[int, str] = {}  # an opening brace and whether it is a class's or a function's
        inside: list[tuple[int, str]] = []  # (closing place, kind or the class's name)
        listed = -1  # up to here Go lists types in parentheses
        for i, x in enumerate(self.value):
            while inside and i > inside[-1][0]:
                inside.pop()
            kind = self.kind[i]
            if kind == "mark" and x == "{":
                inside.append((self.pair[i], bodies.get(i, "")))
            elif kind == "line":
                found = re.match(r'\s*#\s*(?:include|import)\s*[<"]([^>"\n]*)', x)
                if found:
                    self.imports.append(found.group(1))
            elif kind == "word":
                if x in kinds and not self._is(i - 1, ".", "enum", "::"):
                    if self.language == "go" and self._is(i + 1, "("):
                        listed = self.pair[i + 1]
                    elif self._word(i + 1):
                        self._class(i + 1, bodies)
                elif i < listed and (self._is(i - 1, "(", ";") or self.line[i] > self.line[i - 1]) and not inside:
                    self._class(i, bodies)
                elif x in ("import", "use"):
                    self._import(i, bool(inside))
                elif x == "operator" and self.language == "cpp":
                    self._operator(i, bodies)
                elif x in ("enum", "record") and self.language == "java" and self._word(i + 1):
                    opened = self._until(i + 2, "{", ";", "=")
                    if self._is(opened, "{"):
                        bodies[opened] = f"class {self.value[i + 1]}"
                if self._called(i) and not self._function(i, inside, bodies) and x not in self.keywords and i not in self.set_members and not (x in kinds or self._is(i - 1, *kinds)):
                    self._call(i, inside)

    def _called(self, i: int) -> bool:
        """Whether parameters or arguments follow a word, possibly after types in angles."""
        opened = self._parameters(i)
        return self._is(opened, "(") and opened in self.pair

    def _angles(self, i: int) -> int:
        depth, start = 0, i
        while i < len(self.value) and i < start + 60 and not self._is(i, ";", "{", "}", "(", ")", "=", "&", "|") or self._is(i, "=") and depth:
            depth += self._is(i, "<") - self._is(i, ">")
            if not depth:
                return i
            i += 1
        return start

    def _parameters(self, i: int) -> int:
        """The token after word i and after the types in angles that may follow it."""
        if self.language == "rust" and self._is(i + 1, "::") and self._is(i + 2, "<"):
            i += 1
        if self._is(i + 1, "<") and self.language in ("rust", "typescript", "cpp", "java"):
            i = self._angles(i + 1)
        return i + 1

    def _operator(self, i: int, bodies: dict[int, str]) -> None:
        """Marks the body of an operator, which has no name of its own."""
        opened = i + 3 if self._is(i + 1, "(") and self._is(i + 2, ")") else i + 1
        while opened < min(i + 6, len(self.value)) and not self._is(opened, "("):
            opened += 1
        body = self._body(self.pair[opened]) if self._is(opened, "(") else None
        if body is not None:
            bodies[body] = "function"

    def _class(self, i: int, bodies: dict[int, str]) -> None:
        name, go = self.value[i], self.language == "go"
        if go:
            stop = i + 1
            while stop < len(self.value) and self.line[stop] == self.line[i] and not self._is(stop, "{", ";"):
                stop += 1
            opened = stop if self._is(stop, "{") else None
            last = self.pair[stop] if opened else stop - 1
        else:
            stop = self._until(i + 1, "{", ";", "=", ",", ">", ")")
            if self._is(stop, ",", ">") and any(self._is(k, ":", "extends", "implements", "<", "where") for k in range(i + 1, stop)):
                stop = self._until(stop + 1, "{", ";", ")")
            if self.language == "rust" and self._is(stop, ";"):
                opened, last = None, stop
            elif self._is(stop, "{") and not any(self._is(k, "*", "&") for k in range(i + 1, stop) if self.language == "c"):
                opened, last = stop, self.pair[stop]
            else:
                return
        if opened is not None:
            bodies[opened] = f"class {name}"
        start = self._start(i - 1) if self.language == "java" else i if go else i - 1
        self.classes.append({"name": name, "start_line": self.line[start], "end_line": self._last(last)})

    def _last(self, i: int) -> int:
        return self.line[i] + (self.value[i].count("\n") if self.kind[i] == "text" else 0)

    def _function(self, i: int, inside: list[tuple[int, str]], bodies: dict[int, str]) -> bool:
        """Takes word i up as a function's name if it is one."""
        name, where = self.value[i], inside[-1][1] if inside else ""
        in_class, in_function = where.startswith("class "), any(k == "function" for _, k in inside)
        opened = self._parameters(i)
        if not self._is(opened, "("):
            return False
        start, bodiless = i, False
        if self.language == "go":
            receiver = self._is(i - 1, ")") and self._is(self.pair.get(i - 1, 0) - 1, "func")
            if not (self._is(i - 1, "func") or receiver):
                return False
            start, bodiless = (self.pair[i - 1] if receiver else i) - 1, True
        elif self.language == "rust":
            if not self._is(i - 1, "fn"):
                return False
            start = self._start(i)
        elif self.language in ("javascript", "typescript"):
            if self._is(i - 1, "function") or self._is(i - 1, "*") and self._is(i - 2, "function"):
                start = i - 1 if self._is(i - 1, "function") else i - 2
                start -= self._is(start - 1, "async")
            elif name in self.keywords - {"of", "in", "async", "await", "delete", "import"} or not (in_class or self._is(i - 1, "{", ",", "get", "set", "async", "*")) or self._is(i - 1, ".", "new", "=", "=>", "("):
                return False
            else:
                while self._is(start - 1, "get", "set", "async", "static", "*", "public", "private", "protected", "readonly", "override", "abstract"):
                    start -= 1
        elif self.language == "java":
            own = where == f"class {name}"
            if not in_class or name in self.keywords or self._is(i - 1, ".", "new", "@", "="):
                return False
            typed = self._word(i - 1) and self.value[i - 1] not in _BEFORE_CALL or self._is(i - 1, ">", "]")
            if not (own or typed):
                return False
            start, bodiless = self._start(i), typed and not own
        else:
            if in_function or name in self.keywords or self._is(i - 1, ".", "->", "=", "new"):
                return False
            start = self._start(i)
        body = self._body(self.pair[opened])
        if body is None:
            after = self._until(self.pair[opened] + 1, ";", "{", "=") if self.language == "java" else self.pair[opened]
            if not bodiless or self.language == "java" and not self._is(after, ";"):
                return False
            last = after
        else:
            bodies[body], last = "function", self.pair[body]
        name = "~" + name if self._is(i - 1, "~") else name
        self.functions.append({"name": name, "args": self._arguments(opened), "start_line": self.line[start], "end_line": self._last(last)})
        return True

    def _call(self, i: int, inside: list[tuple[int, str]]) -> None:
        before = i - 1
        if self._is(before, "new", "@", "fn", "func", "function", "~") or self.language in ("rust", "cpp") and self._is(before, "::"):
            return
        declared = self._word(before) and self.value[before] not in _BEFORE_CALL  # the word before is a type
        in_function = any(kind == "function" for _, kind in inside)
        if self.language in ("c", "cpp"):
            typed = self._is(before, ">") and any(self._is(k, "<") for k in range(max(0, before - 8), before))
            if declared or typed or not in_function and not self._is(before, "=", "(", ",", "+", "-", "|", "!", ".", "->"):
                return
        elif inside and inside[-1][1].startswith("class "):  # a signature, unless it is part of a value
            if declared or before < 0 or self._is(before, "{", "}", ";", ")", "]", "*", ">", ",") or self.language in ("go", "rust"):
                return
        elif self.language == "java" and declared:
            return
        self.calls.append({"callee": self.value[i], "line": self.line[i]})

    def _import(self, i: int, nested: bool) -> None:
        language = self.language
        if language == "go" and self.value[i] == "import":
            stop = self.pair[i + 1] if self._is(i + 1, "(") else min(len(self.value), i + 3)
            self.imports += [self.value[k][1:-1] for k in range(i + 1, stop) if self.kind[k] == "text"][: None if self._is(i + 1, "(") else 1]
        elif language == "java" and self.value[i] == "import" and not nested:
            stop = self._until(i, ";")
            self.imports.append("".join(x for x in self.value[i + 1 : stop] if x != "static"))
        elif language == "rust" and self.value[i] == "use":
            stop = self._until(i, ";")
            if stop < len(self.value):
                self.imports.append(self.source[self.at[i + 1] : self.at[stop]].strip())
        elif language in ("javascript", "typescript") and self.value[i] == "import" and not nested and not self._is(i + 1, "(", "."):
            for k in range(i + 1, min(len(self.value), i + 400)):
                if self._is(k, ";"):
                    return
                if self.kind[k] == "text":
                    self.imports.append(self.value[k][1:-1])
                    return
