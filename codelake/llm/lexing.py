"""Token classes of source texts, one character per token, for the tables of ``parsing``."""

from __future__ import annotations

import re

from codelake.llm.parsing import BAD, DEDENT, INDENT, NEWLINE, Grammar, Tables

#: Names a worker remembers per language.
REMEMBERED = 100_000
WORD = r"[^\W\d][\w]*"


class Classes(dict):
    """Character of a token; names that are no keywords share one, and so do numbers and strings."""

    def __init__(self, tables: Tables, grammar: Grammar):
        self.fixed = {text: c for text, c in tables.terminals.items() if not re.fullmatch("<[A-Z]+>", text)}
        for key, text in grammar.directives.items():
            if key.startswith("class_"):  # several tokens that stand in the same places
                for token in text.split():
                    self.fixed[token] = tables.terminal(f"<{key.removeprefix('class_')}>")
        for word in grammar.directives.get("reserved", "").split():
            self.fixed.setdefault(word, BAD)
        self.words = {k: tables.terminal(f"<{k}>") for k in ("IDENT", "NUMBER", "STRING", "MEMBER", "REGEX", "LIFETIME", "AT", "HTML")}
        self.comment = tuple(grammar.directives.get("comment", "// /*").split())
        self.update(self.fixed)

    def __missing__(self, token: str) -> str:
        first, last = token[0], token[-1]
        if token.startswith(self.comment):
            # one that the pattern could not close is no comment
            return BAD if token == "/*" else NEWLINE if "\n" in token else ""
        if first == "\n":
            return NEWLINE
        if token.startswith("?>"):
            return self.words["HTML"]
        if len(token) > 1 and last in "\"'`#":
            found = self.words["STRING"]
        elif first == "@" and len(token) > 1:
            found = self.words["AT"]
        elif first.isalpha() or first in "_$\\" or (first == "#" and len(token) > 1):
            found = self.words["IDENT"]
        elif first.isdigit() or (first == "." and token[1:2].isdigit()):
            found = self.words["NUMBER"]
        elif first == "'" and len(token) > 1:
            found = self.words["LIFETIME"]
        elif first in ".?" and len(token) > 1 and (last.isalnum() or last in "_$"):
            found = self.words["MEMBER"]
        elif first == "/" and len(token) > 2:
            found = self.words["REGEX"]
        elif token.startswith("<<<"):
            found = self.words["STRING"]
        else:
            return BAD
        if len(token) <= 40:
            if len(self) > REMEMBERED:
                self.clear()
                self.update(self.fixed)
            self[token] = found
        return found


STRING_DOUBLE = r'"(?:[^"\\\n]|\\[\s\S])*"'
STRING_SINGLE = r"'(?:[^'\\\n]|\\[\s\S])*'"
BLOCK_COMMENT = r"/\*[\s\S]*?\*/|/\*"
LINE_COMMENT = r"//[^\n]*"
NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"
OPERATORS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|<=>|->|=>|::|:=|<-|\+\+|--|&&|\|\||\?\?|==|!=|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|\.\.=|\.\.|\?\.|>=|##"
_MEMBER = rf"(?:\?\.|(?<![\d.])\.)\s*#?[^\W\d][\w$]*"

_SPLIT_OPERATORS = OPERATORS.replace("|>=", "").replace(">>>=|", "").replace("|>>=", "")  # where > also closes type lists
_DIRECTIVE = r"(?m:^[ \t]*#[ \t]*(?:include|define|undef|ifdef|ifndef|if|elif|else|endif|pragma|error|warning|line)\b(?:[^\n\\/]|\\[\s\S]|/(?![/*]))*)"

#: The rest of a template from its beginning or a closed expression: to its end or the next expression.
_TEMPLATE = r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$\{)"
#: Name, signs and blanks of markup in a script.
_MARKUP = r"[^\W\d][\w$]*(?:[.:-][\w$-]+)*"

#: What the tokens of a language look like, in the order tried; blanks between tokens match nothing and fall out.
PATTERNS = {
    "javascript": "|".join((
        r"\A#![^\n]*", LINE_COMMENT, BLOCK_COMMENT, STRING_DOUBLE, STRING_SINGLE, "`" + _TEMPLATE,
        r"(?:(?<=[(,=:\[!&|?{};\n>])|(?<=[(,=:\[!&|?{};>] )|(?<=return )|(?<=\A))/(?![*/\s=])(?:[^\\/\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*",
        _MEMBER, NUMBER + r"n?(?![\w$])", r"[#@]?[^\W\d][\w$]*|\$[\w$]*", OPERATORS, r"\n", r"\S",
    )),
    "typescript": "|".join((
        r"\A#![^\n]*", LINE_COMMENT, BLOCK_COMMENT, STRING_DOUBLE, STRING_SINGLE, "`" + _TEMPLATE,
        r"(?:(?<=[(,=:\[!&|?{};\n>])|(?<=[(,=:\[!&|?{};>] )|(?<=return )|(?<=\A))/(?![*/\s=])(?:[^\\/\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*",
        _MEMBER, NUMBER + r"n?(?![\w$])", r"[#@]?[^\W\d][\w$]*|\$[\w$]*", _SPLIT_OPERATORS, r"\n", r"\S",
    )),
    "go": "|".join((LINE_COMMENT, BLOCK_COMMENT, STRING_DOUBLE, r"'(?:[^'\\\n]|\\(?:x..|u....|U........|[0-7]{3}|.))'", r"`[^`]*`", NUMBER + r"i?(?!\w)", WORD, r"&\^=|&\^", OPERATORS, r"\n", r"\S")),
    "java": "|".join((LINE_COMMENT, BLOCK_COMMENT, r'"""[\s\S]*?"""', STRING_DOUBLE, r"'(?:[^'\\\n]|\\(?:u+....|[0-7]{1,3}|.))'", NUMBER + r"[lLfFdD]?(?![\w$])", r"@?[^\W\d][\w$]*|\$[\w$]*", _SPLIT_OPERATORS, r"\S")),
    "csharp": "|".join((
        LINE_COMMENT, BLOCK_COMMENT, r'\$?@\$?"(?:[^"]|"")*"', r'"""[\s\S]*?"""', r"\$?" + STRING_DOUBLE, r"'(?:[^'\\\n]|\\(?:u....|x.{1,4}|.))'",
        NUMBER + r"[uUlLfFdDmM]{0,2}(?!\w)", r"(?m:^[ \t]*#(?:region|endregion|if|elif|else|endif|define|undef|pragma|nullable|warning|error|line)\b[^\n]*)", WORD, _SPLIT_OPERATORS, r"\S",
    )),
    "rust": "|".join((
        LINE_COMMENT, r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/|/\*", r'b?r"[^"]*"|b?r#"[\s\S]*?"#(?!#)|b?r##"[\s\S]*?"##', r'[bc]?"(?:[^"\\]|\\[\s\S])*"',
        r"b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))'", r"'[^\W\d]\w*", r"\d[\d_]*(?=\.\.)", NUMBER + r"(?:_?[iuf](?:8|16|32|64|128|size))?(?!\w)", r"r#" + WORD, WORD, _SPLIT_OPERATORS, r"\S",
    )),
    "c": "|".join((
        _DIRECTIVE, LINE_COMMENT, BLOCK_COMMENT, r'(?:u8|[uUL])?R"\([\s\S]*?\)"', r"(?:u8|[uUL])?" + STRING_DOUBLE, r"(?:u8|[uUL])?" + STRING_SINGLE,
        r"(?:0[xX][\da-fA-F']+|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d[\d']*)(?:[eE][+-]?\d+)?)[uUlLfFzZ]{0,3}(?!\w)", r"[^\W\d][\w$]*", _SPLIT_OPERATORS, r"\S",
    )),
    "php": "|".join((
        r"\?>\n?(?:(?!<\?(?:php\b|=))[\s\S])*(?:<\?(?:php\b|=)|\Z)", r"#(?!\[)(?:(?!\?>)[^\n])*|//(?:(?!\?>)[^\n])*", BLOCK_COMMENT, r'"(?:[^"\\]|\\[\s\S])*"', r"'(?:[^'\\]|\\[\s\S])*'",
        r"`(?:[^`\\]|\\[\s\S])*`", r"<<<[ \t]*[\"']?(?P<doc>\w+)[\"']?\n[\s\S]*?\n?[ \t]*(?P=doc)\b", r"\?->", r"\$+[^\W\d]\w*", NUMBER + r"(?!\w)", r"\\?[^\W\d]\w*(?:\\[^\W\d]\w*)*", OPERATORS, r"\S",
    )),
    "python": "|".join((
        r"#[^\n]*", r'(?i:[rbuft]{0,2})(?:"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*\'\'\')', r"(?i:[rbuft]{0,2})(?:" + STRING_DOUBLE + "|" + STRING_SINGLE + ")",
        r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])|0(?:_?0)*|[1-9](?:_?\d)*)(?!\w)",
        WORD, r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|==|!=|<=|>=|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=", r"\\\n", r"\n[ \t\f]*", r"\S",
    )),
}
PATTERNS["cpp"] = PATTERNS["c"]


IN_TYPE_LISTS = "<IDENT> <MEMBER> <STRING> <NUMBER> <TYPES> <LIFETIME> <SIGN> <AT> <PRIM> , . :: ? & && | * : = ! extends super const => -> keyof typeof mut dyn impl in out typename class readonly null void ref struct enum this unsigned signed as".split()
BEFORE_TYPE_LISTS = "<MOD> = ( , return => ; { <IDENT> <MEMBER> <PRIM> :: fn template impl for new . public private protected static final abstract operator".split()


def typed_lists(tokens: str, tables: Tables) -> str:
    """Lists between < and > that can only hold types become one token, from the inside out."""
    t = tables.terminals
    inside = "".join(re.escape(t[x]) for x in IN_TYPE_LISTS if x in t)
    before = "".join(re.escape(t[x]) for x in BEFORE_TYPE_LISTS if x in t)
    flat = rf"(?<=[{before}]){re.escape(t["<"])}(?:[{inside}]|\[[{inside};]*\]|\([{inside}]*\)|\{{[{inside};]*\}})*{re.escape(t[">"])}"
    count = 1
    while count:
        tokens, count = re.subn(flat, t["<TYPES>"], tokens)
    return tokens


def line_ends(tokens: str, tables: Tables) -> str:
    """Statement ends that a language puts in at line ends, behind the tokens that can end a statement."""
    enders = "".join(re.escape(tables.terminal(x)) for x in ("<IDENT>", "<NUMBER>", "<STRING>", "return", "break", "continue", "fallthrough", "++", "--", ")", "]", "}"))
    return re.sub(f"(?<=[{enders}])\n+", tables.terminal(";"), tokens + "\n").replace("\n", "")


def layout(found: list[str], classes: Classes) -> str:
    """Line ends, indents and dedents for a language that has them; a line end within brackets is none."""
    kept = [t for t in found if t[0] != "#" and t != "\\\n"]
    kept.append("\n")
    out: list[str] = []
    columns, depth = [(0, 0)], 0
    for at, token in enumerate(kept):
        if token[0] != "\n":
            kind = classes[token]
            depth += (kind in "([{") - (kind in ")]}")
            out.append(kind)
        elif depth <= 0:
            last = at + 1 == len(kept)
            if not last and kept[at + 1][0] == "\n":
                continue
            if out and out[-1] not in (NEWLINE, DEDENT):
                out.append(NEWLINE)
            indent = "" if last else token[1:].rpartition("\f")[2]
            column = (len(indent.expandtabs(8)), len(indent))
            if column[0] > columns[-1][0] and column[1] > columns[-1][1]:
                columns.append(column)
                out.append(INDENT)
            else:
                while column[0] < columns[-1][0]:
                    columns.pop()
                    out.append(DEDENT)
                if column != columns[-1]:
                    out.append(BAD)
    return "".join(out)


class Script:
    """Tokens of a script with templates or markup in it: the expressions within them stand in brackets behind a string."""

    rest = re.compile(_TEMPLATE).match
    tag = re.compile(rf"<(?:({_MARKUP})(?=[\s/>]))?(?!\s+extends\b)(?=[\s/>])").match
    attribute = re.compile(rf"\s*(?:({_MARKUP})(?:\s*=\s*(\"[^\"]*\"|'[^']*'|(?=[{{<])))?|(?=\{{\s*\.\.\.)|(/?>))").match
    text = re.compile(r"[^<{}>]*").match
    closing = re.compile(rf"</\s*({_MARKUP})?\s*>").match
    #: What an expression, and so markup, may follow.
    opens = frozenset("( , = : [ ! && || ? ?? { } ; => return default".split())

    def __init__(self, pattern: re.Pattern, source: str, markup: bool):
        self.search, self.source, self.markup = pattern.search, source, markup

    def tokens(self, at: int = 0, inner: bool = False) -> tuple[list[str], int]:
        """The tokens from a place on; ``inner``: to the brace that closes it, which is passed."""
        out: list[str] = []
        depth, last = 0, ";"
        while found := self.search(self.source, at):
            token, at = found[0], found.end()
            if token[0] == "`" and len(token) > 1:
                out.append("``")
                while token[-1] == "{":
                    inside, at = self.tokens(at, True)
                    more = self.rest(self.source, at)
                    out += ["[", *inside, "]", "``"]
                    if more is None:
                        return [*out, "`"], len(self.source)
                    token, at = more[0], more.end()
                last = "`"
                continue
            if token == "<" and self.markup and last in self.opens:
                made = self.element(found.start())
                if made is not None:
                    out += made[0]
                    at, last = made[1], "`"
                    continue
            if inner and token in "{}":
                if token == "}" and not depth:
                    return out, at
                depth += 1 if token == "{" else -1
            out.append(token)
            if token != "\n" and not token.startswith(("//", "/*")):
                last = token
        return (["`", *out], at) if inner else (out, at)

    def braced(self, at: int) -> tuple[list[str], int]:
        """An expression in braces; one of nothing but blanks and comments stands for a string."""
        inside, at = self.tokens(at + 1, True)
        inside = inside[1:] if inside[:1] == ["..."] else inside
        blank = all(t == "\n" or t.startswith(("//", "/*")) for t in inside)
        return ["[", *(["``"] if blank else inside), "]"], at

    def element(self, at: int) -> tuple[list[str], int] | None:
        """Markup from its ``<`` on, or None where it is none."""
        head = self.tag(self.source, at)
        if head is None:
            return None
        out, at = ["``"], head.end()
        while True:
            part = self.attribute(self.source, at)
            if part is None:
                return None
            at = part.end()
            if part[3]:
                break
            if self.source[at : at + 1] == "{" and (part[1] is None or part[2] == ""):
                inside, at = self.braced(at)
                out += inside
            elif part[2] == "":
                inside = self.element(at)
                if inside is None:
                    return None
                out += ["[", *inside[0], "]"]
                at = inside[1]
        if part[3] == "/>":
            return out, at
        while True:
            at = self.text(self.source, at).end()
            end = self.closing(self.source, at)
            if end:
                return (out, end.end()) if end[1] == head[1] else None
            sign = self.source[at : at + 1]
            if sign == "{":
                inside, at = self.braced(at)
                out += inside
            elif sign == "<" and (inside := self.element(at)) is not None:
                out += ["[", *inside[0], "]"]
                at = inside[1]
            else:
                return None


_BRANCH = re.compile(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|elif|else|endif)\b", re.MULTILINE)


def one_branch(text: str, last: bool) -> str:
    """The text with the first, or the last, branch alone of each conditional of the preprocessor."""
    cuts: list[tuple[int, int]] = []
    open_: list[list[int]] = []  # where each branch of an open conditional begins
    for found in _BRANCH.finditer(text):
        if found[1].startswith("if"):
            open_.append([found.start()])
        elif open_:
            open_[-1].append(found.start())
            if found[1] == "endif":
                marks = open_.pop()
                if len(marks) > 2:
                    cuts += [(marks[0], marks[-2])] if last else [(marks[1], marks[-1])]
    kept, at = [], 0
    for start, end in sorted(cuts):
        if start >= at:
            kept.append(text[at:start])
            at = end
    return "".join([*kept, text[at:]])


class Lexer:
    """Turns a text into the token classes of one language's tables."""

    def __init__(self, language: str, tables: Tables, grammar: Grammar):
        self.language, self.tables = language, tables
        self.classes = Classes(tables, grammar)
        pattern = re.compile(PATTERNS[language])
        self.pattern = pattern
        self.find = pattern.findall if not pattern.groups else lambda text: [m[0] for m in pattern.finditer(text)]
        self.types = "<TYPES>" in tables.terminals
        self.script = language in ("javascript", "typescript")

    def __call__(self, text: str, markup: bool = False) -> str:
        """``markup``: the text is of a dialect with markup among its expressions."""
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        text = text.removeprefix("\ufeff")
        if self.language == "python":
            return layout(self.find("\n" + text), self.classes)
        if self.language == "php":
            text = "?>" + text  # a file begins outside the code
        found = Script(self.pattern, text, markup).tokens()[0] if self.script and ("${" in text or (markup and "<" in text)) else self.find(text)
        tokens = "".join(map(self.classes.__getitem__, found))
        if self.types:
            tokens = typed_lists(tokens, self.tables)
        if self.language == "go":
            return line_ends(tokens, self.tables)
        return tokens if self.tables.insert else tokens.replace(NEWLINE, "")
