"""Source files to chunks, symbols and relationships."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions.paths import language as language_of
from codelake.functions.text import chunk_id
from codelake.session import stripped

# How definitions begin, by language, and the chunk type each makes. Group 1 is the name.
_JS = [
    ("class_declaration", r"(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+([\w$]+)"),
    ("function_declaration", r"(?:export\s+(?:default\s+)?)?(?:async\s+)?function\b\s*\*?\s*([\w$]+)"),
    ("arrow_function", r"(?:export\s+(?:default\s+)?)?(?:(?:const|let|var)\s+)?([\w$.]+)\s*(?::[^=;{}()]+)?=\s*(?:async\s+)?(?:\([^;{}]*\)|[\w$]+)\s*(?::[^=;{}]+)?=>\s*(?=\{)"),
    ("function", r"(?:export\s+(?:default\s+)?)?(?:(?:const|let|var)\s+)?([\w$.]+)\s*=\s*(?:async\s+)?function\b\s*\*?\s*[\w$]*\s*(?=\()"),
    ("method_definition", r"(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*(?!(?:if|for|while|switch|catch|with|return|function|else|do|new|await|typeof)\b)([\w$#]+)(?:<[^<>(){}]*>)?\s*\([^;{}]*\)\s*(?::[^;{}]+)?(?=\{)"),
]
_TYPED = r"(?:(?:public|private|protected|internal|static|final|abstract|synchronized|native|virtual|override|sealed|async|partial|default)[ \t]+)*+"
DEFINITIONS = {
    "javascript": _JS,
    "typescript": [*_JS, ("interface_declaration", r"(?:export\s+)?(?:declare\s+)?interface\s+(\w+)"), ("type_alias_declaration", r"(?:export\s+)?(?:declare\s+)?type\s+(\w+)(?:<[^<>]*>)?\s*=")],
    "php": [
        ("class_declaration", r"(?:(?:abstract|final|readonly)\s+)*class\s+(\w+)"), ("interface_declaration", r"interface\s+(\w+)"), ("trait_declaration", r"trait\s+(\w+)"),
        ("method_declaration", r"(?:(?:public|private|protected|static|final|abstract)\s+)+function\s+&?(\w+)"), ("function_definition", r"function\s+&?(\w+)"),
    ],
    "go": [("method_declaration", r"func\s*\([^)]*\)\s*(\w+)"), ("function_declaration", r"func\s+(\w+)"), ("interface_type", r"type\s+(\w+)\s+interface\b"), ("type_declaration", r"type\s+(\w+)")],
    "rust": [
        ("function_item", r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|extern)\s+)*fn\s+(\w+)"), ("struct_item", r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"),
        ("enum_item", r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait_item", r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)"), ("impl_item", r"(?:unsafe\s+)?impl\b(?:<[^{};]*?>)?\s*(?:[\w:<>, &']+\s+for\s+)?(\w+)"),
    ],
    "java": [
        ("class_declaration", rf"{_TYPED}class\s+(\w+)"), ("interface_declaration", rf"{_TYPED}interface\s+(\w+)"), ("enum_declaration", rf"{_TYPED}enum\s+(\w+)"),
        ("method_declaration", rf"{_TYPED}(?!(?:return|new|else|throw|class|interface|enum|package|import)\b)[\w.]++(?:<[\w<>, .?\[\]&]{{0,120}}>)?(?:\[\])*\??[ \t]+(?!(?:if|for|while|switch|catch|synchronized)\b)(\w+)\s*\([^;{{}}]*\)\s*(?:throws\s+[\w., ]+)?(?=\{{)"),
    ],
    "csharp": [
        ("class_declaration", rf"{_TYPED}class\s+(\w+)"), ("interface_declaration", rf"{_TYPED}interface\s+(\w+)"), ("struct_declaration", rf"{_TYPED}struct\s+(\w+)"),
        ("method_declaration", rf"{_TYPED}(?!(?:return|new|else|throw|class|interface|struct|namespace|using)\b)[\w.]++(?:<[\w<>, .?\[\]&]{{0,120}}>)?(?:\[\])*\??[ \t]+(?!(?:if|for|while|switch|catch|foreach|lock|fixed|using)\b)(\w+)\s*\([^;{{}}]*\)\s*(?=\{{)"),
    ],
    "cpp": [
        ("namespace_definition", r"namespace\s+([\w:]+)"), ("class_specifier", r"class\s+(\w+)"), ("struct_specifier", r"struct\s+(\w+)"),
        ("function_definition", r"(?!(?:return|else|new|throw|case|class|struct|namespace|using)\b)(?:[\w:<>,&*~]++[ \t]+)++[*&]*(?!(?:if|for|while|switch|catch)\b)([\w:~]+)\s*\([^;{}]*\)\s*(?:const\s*)?(?=\{)"),
    ],
    "c": [("struct_specifier", r"struct\s+(\w+)"), ("function_definition", r"(?!(?:return|else|case|struct)\b)(?:[\w*]++[ \t]+)++\**(?!(?:if|for|while|switch)\b)(\w+)\s*\([^;{}]*\)\s*(?=\{)")],
}
# Words before a bracket that are no calls.
NO_CALLS = frozenset("if for while switch catch return function func fn def class elif except with match print not and or in is lambda await typeof sizeof new foreach isset empty array list unset echo and super self assert del raise yield".split())

_STRINGS = r'"(?:[^"\\\n]|\\[\s\S])*"|`(?:[^`\\]|\\[\s\S])*`|/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*'
_QUOTED = r"'(?:[^'\\\n]|\\[\s\S])*'"
_PATTERN = r"(?:(?<=[(,=:\[!&|?{};])|(?<=[(,=:\[!&|?{};] )|(?<=return ))/(?![*/\s=])(?:[^\\/\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
#: Strings and comments, and the regular expressions of JavaScript; a lone quote is no string where it marks a lifetime.
_NOISE = {
    "python": re.compile(r'"""[\s\S]*?(?:"""|\Z)|' + r"'''[\s\S]*?(?:'''|\Z)|" + r'"(?:[^"\\\n]|\\[\s\S])*"|' + _QUOTED + r"|#[^\n]*"),
    "php": re.compile(_STRINGS + "|" + _QUOTED + r"|#(?!\[)[^\n]*"),
    "rust": re.compile(r'r(#*)"[\s\S]*?"\1|' + _STRINGS + r"|'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))'"),
    "javascript": re.compile(_PATTERN + "|" + _STRINGS + "|" + _QUOTED),
    "": re.compile(_STRINGS + "|" + _QUOTED),
}
_NOISE["typescript"] = _NOISE["javascript"]
_BRACES = re.compile(r"[{}]")
_MARK = re.compile(r"[{;]")
_PYTHON = re.compile(r"^([ \t]*)(async\s+def|def|class|@)\s*(\w+)?", re.MULTILINE)
CALL = re.compile(r"([A-Za-z_$][\w$]*)\s*\(")


def blanked(text: str, language: str) -> str:
    """The text with strings and comments as blanks of the same length; line ends stay."""
    return _NOISE.get(language, _NOISE[""]).sub(lambda m: "\n".join(" " * len(x) for x in m[0].split("\n")), text)


def _heads(definitions: list[tuple[str, str]]) -> re.Pattern:
    return re.compile("|".join(f"(?P<d{n}>^[ \\t]*{p})" for n, (_, p) in enumerate(definitions)), re.MULTILINE)


def _braced(code: str, known: list[tuple[str, str]], heads: re.Pattern) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, type, name) of the definitions in code with braces, ends behind the closing brace or the semicolon."""
    kinds = [kind for kind, _ in known]
    closing: dict[int, int] = {}
    opened: list[int] = []
    for brace in _BRACES.finditer(code):
        if brace[0] == "{":
            opened.append(brace.start())
        elif opened:
            closing[opened.pop()] = brace.end()
    for head in heads.finditer(code):
        number = next(n for n in range(len(kinds)) if head[f"d{n}"] is not None)
        start = head.end() - len(head[0].lstrip())
        mark = _MARK.search(code, head.end())
        end = mark and (mark.end() if mark[0] == ";" else closing.get(mark.start()))
        if end:
            yield start, end, kinds[number], next(g for g in head.groups()[head.re.groupindex[f"d{number}"] :] if g)


def _indented(code: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, type, name) of Python's definitions; decorators make one definition with what they decorate."""
    lines = [m for m in re.finditer(r"[^\n]*\n|[^\n]+", code)]
    starts = {m.start(): n for n, m in enumerate(lines)}
    decorated: tuple[int, int] | None = None
    for head in _PYTHON.finditer(code):
        indent, at = len(head[1]), starts[head.start()]
        if head[2] == "@":
            decorated = decorated if decorated and decorated[1] == indent else (head.start() + indent, indent)
            continue
        end = head.end()
        for line in lines[at + 1 :]:
            text = line[0]
            if text.strip():
                if len(text) - len(text.lstrip()) <= indent and not text.lstrip().startswith((")", "]", "}")):
                    break
                end = line.start() + len(text.rstrip())
        kind = "class_definition" if head[2] == "class" else "function_definition"
        if decorated and decorated[1] == indent:
            yield decorated[0], end, "decorated_definition", head[3]
        else:
            yield head.start() + indent, end, kind, head[3]
        decorated = None


def definitions(text: str, language: str, known: dict[str, list[tuple[str, str]]] | None = None, heads: dict[str, re.Pattern] | None = None) -> list[tuple[int, int, str, str]]:
    """All definitions of a text, outer before inner; nothing for other languages. ``known`` are those registered, with their patterns."""
    known = DEFINITIONS if known is None else known
    code = blanked(text, language)
    if language == "python":
        found = _indented(code)
    elif language in known:
        found = _braced(code, known[language], heads[language] if heads else _heads(known[language]))
    else:
        found = iter(())
    return sorted(found, key=lambda d: (d[0], -d[1]))


def chunk(text: str, language: str, limit: int, known: dict[str, list[tuple[str, str]]] | None = None, heads: dict[str, re.Pattern] | None = None) -> list[dict]:
    """Definitions within the limit, not those inside them; a larger one gives way to what is defined within it."""
    out: list[dict] = []
    parents: list[tuple[int, str, str]] = []
    skip = 0
    for start, end, kind, name in definitions(text, language, known, heads):
        parents = [p for p in parents if p[0] > start]
        if start < skip:
            continue
        if end - start > limit:
            parents.append((end, kind, name or ""))
            continue
        skip = end
        line = text.count("\n", 0, start) + 1
        out.append({
            "start_line": line, "end_line": line + text.count("\n", start, end), "start_byte": len(text[:start].encode()), "end_byte": len(text[:end].encode()),
            "chunk_type": kind, "name": name, "content": text[start:end], "context": " > ".join(f"{k}:{n}" for _, k, n in parents),
        })
    return out


CHUNK_FIELDS = [("start_line", pa.int32()), ("end_line", pa.int32()), ("start_byte", pa.int32()), ("end_byte", pa.int32()), ("chunk_type", pa.string()), ("name", pa.string()), ("content", pa.string()), ("context", pa.string())]


def chunk_files(files: DataFrame, limit: int = 2048) -> DataFrame:
    """Chunks of source files: id, repo_name, file_path, language and the chunk's own columns.

    Null texts and languages without definitions give none, and no text raises; a repeated file gives its chunks once.
    """

    known, extensions = dict(DEFINITIONS), dict(REGISTERED)  # what is registered now goes with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = {language: _heads(own) for language, own in known.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(n, c) for n, (x, t) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)) for c in chunk(t, x, limit, known, heads)]
                index = pa.array([n for n, _ in rows], pa.int64())
                columns = [part.column(i).take(index) for i in range(3)] + [pa.array([c[name] for _, c in rows], kind) for name, kind in CHUNK_FIELDS]
                yield pa.RecordBatch.from_arrays(columns, names=["repo_name", "file_path", "language", *(name for name, _ in CHUNK_FIELDS)])

    language = language_of(F.col("file_path"))
    for extension, name in extensions.items():
        language = F.when(F.lower("file_path").endswith(extension), name).otherwise(language)
    source = files.select("repo_name", "file_path", language.alias("language"), "content").where("language is not null and content != ''").distinct()
    schema = "repo_name string, file_path string, language string, start_line int, end_line int, start_byte int, end_byte int, chunk_type string, name string, content string, context string"
    made = source.mapInArrow(run, schema)
    return made.select(chunk_id(F.col("file_path"), F.col("start_line"), F.col("content")).alias("id"), "*")


def symbols(chunks: DataFrame, symbol_type: str | None = None) -> DataFrame:
    """Symbol rows of chunks; the type filter is a part of the chunk type in any case."""
    rows = chunks if symbol_type is None else chunks.where(F.lower("chunk_type").contains(symbol_type.lower()))
    return rows.select(
        "repo_name", "file_path", F.coalesce("name", F.lit("anonymous")).alias("name"), F.col("chunk_type").alias("type"), "start_line", "end_line",
        F.coalesce(F.nullif("context", F.lit("")), F.lit("N/A")).alias("context"),
    )


def search(chunks: DataFrame, repo: str | None = None, language: str | None = None, path_part: str | None = None, chunk_type: str | None = None, match: str = "equals") -> DataFrame:
    """Chunks that pass all given filters; the chunk type must equal, or with match="contains" contain, the wanted one."""
    rows = chunks
    for column, value in (("repo_name", repo), ("language", language)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows if path_part is None else rows.where(F.col("file_path").contains(path_part))
    if chunk_type is not None:
        rows = rows.where(F.col("chunk_type") == chunk_type if match == "equals" else F.lower("chunk_type").contains(chunk_type.lower()))
    return rows


def calls(chunks: DataFrame) -> DataFrame:
    """(repo_name, id, callee, line): calls in the chunks' code, names before a bracket that are no keyword and not defined there.

    Strings and comments hold no calls; a definition's own head is none. Null texts and lines give no rows or no line.
    """

    def found(text: str, language: str, name: str | None, first: int) -> list[tuple[str, int]]:
        code = blanked(text, language)
        return [(m[1], first + code.count("\n", 0, m.start())) for m in CALL.finditer(code) if m[1] not in NO_CALLS and m[1] != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(n, callee, line) for n, (text, x, name, first) in enumerate(zip(*(part.column(i).to_pylist() for i in range(2, 6)), strict=True)) for callee, line in found(text, x, name, first)]
                index = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(1).take(index), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], names=["repo_name", "id", "callee", "line"])

    language = F.coalesce(F.lower("language"), F.lit("")).alias("language")
    rows = chunks.where("content is not null").select("repo_name", "id", "content", language, "name", F.coalesce("start_line", F.lit(1)).cast("int").alias("start_line"))
    return rows.mapInArrow(run, "repo_name string, id string, callee string, line int")


def resolve_calls(made: DataFrame, chunks: DataFrame) -> DataFrame:
    """Calls with the id of the first function or method of that name in the caller's own file, else null."""
    places = chunks.select("repo_name", "id", "file_path")
    functions = chunks.where(F.col("chunk_type").rlike("^(function|method)") & F.col("name").isNotNull())
    first = functions.groupBy("repo_name", "file_path", F.col("name").alias("callee")).agg(F.min_by("id", F.struct("start_byte", "id")).alias("target_id"))
    return made.join(places.dropDuplicates(["repo_name", "id"]), ["repo_name", "id"]).join(first, ["repo_name", "file_path", "callee"], "left")


def bases(chunks: DataFrame) -> DataFrame:
    """(repo_name, id, base, type): what classes extend or implement, from the head of their text."""
    head = F.regexp_extract("content", r"^([^{\n]*)", 1)
    python = F.regexp_extract(head, r"^class\s+\w+\s*\(([^)]*)\)", 1)
    extends = F.regexp_extract(head, r"\bextends\s+([\w.$\\]+)", 1)
    colon = F.regexp_extract(head, r"\bclass\s+\w+(?:<[^>]*>)?\s*:\s*(?:public\s+|private\s+|protected\s+)?([\w.:, ]+)", 1)
    implements = F.regexp_extract(head, r"\bimplements\s+([\w.$, \\]+)", 1)
    is_python = F.col("language") == "python"
    parents = F.when(is_python, python).when(F.col("language").isin("csharp", "cpp"), colon).otherwise(extends)
    rows = chunks.where(F.col("chunk_type").rlike("^(class|interface)")).select("repo_name", "id", "language", parents.alias("p"), implements.alias("i"))
    split = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^[\w.:$\\]+$"))
    up = rows.select("repo_name", "id", "language", F.explode(split("p")).alias("base"), F.lit("EXTENDS").alias("type"))
    up = up.withColumn("type", F.when((F.col("language") == "csharp") & F.col("base").rlike("^I[A-Z]"), "IMPLEMENTS").otherwise(F.col("type")))
    across = rows.select("repo_name", "id", "language", F.explode(split("i")).alias("base"), F.lit("IMPLEMENTS").alias("type"))
    return up.unionByName(across).select("repo_name", "id", "base", "type")


# Import statements by language; group 1 is the module.
IMPORTS = {
    "python": r"(?m)^[ \t]*(?:from|import)[ \t]+([\w.]+)",
    "javascript": r"""(?m)(?:\bfrom[ \t]*|\brequire\(|^[ \t]*import[ \t]+)["']([^"'\n]+)["']""",
    "typescript": r"""(?m)(?:\bfrom[ \t]*|\brequire\(|^[ \t]*import[ \t]+)["']([^"'\n]+)["']""",
    "php": r"(?m)^[ \t]*use[ \t]+([\w\\]+)",
    "go": r'(?m)^(?:import)?[ \t]*(?:\w+[ \t]+)?"([\w./-]+)"[ \t]*\r?$',
    "rust": r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+([\w:]+)",
    "java": r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)",
    "cpp": r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]',
    "c": r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]',
    "csharp": r"(?m)^[ \t]*using[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;",
}


def imports(files: DataFrame) -> DataFrame:
    """(repo_name, file_path, language, module, is_relative): the distinct imports of source files, without running any code of them."""
    language = language_of(F.col("file_path"))
    found = F.lit(None).cast("array<string>")
    for name, pattern in IMPORTS.items():
        found = F.when(language == name, F.regexp_extract_all("content", F.lit(pattern.replace("(?m)", "(?md)")), 1)).otherwise(found)
    rows = files.select("repo_name", "file_path", language.alias("language"), F.explode(found).alias("module")).distinct()
    return rows.withColumn("is_relative", F.col("module").startswith("."))


#: Languages registered with extensions of their own, by extension with its dot.
REGISTERED: dict[str, str] = {}


def register(language: str, definitions: list[tuple[str, str]], imports_pattern: str | None = None, extensions: tuple[str, ...] = ()) -> None:
    """Adds or replaces what a language's definitions (type and pattern, group 1 the name), imports and files look like, from the next query on."""
    _heads(definitions)  # a wrong pattern is told here
    DEFINITIONS[language] = definitions
    REGISTERED.update({"." + x.lower().lstrip("."): language for x in extensions})
    if imports_pattern is not None:
        IMPORTS[language] = imports_pattern


def registered() -> list[str]:
    """The languages that definitions are known of."""
    return sorted({*DEFINITIONS, "python"})


def extractor(language: str) -> tuple[list[tuple[str, str]], str | None]:
    """Definitions and import pattern of a language; nothing for an unknown one."""
    return DEFINITIONS.get(language, []), IMPORTS.get(language)


# What may stand behind an imported path for it to be a file.
SUFFIXES = (".py", "/__init__.py", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", "/index.js", "/index.ts", ".h", ".hpp", "")


def file_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_name, file_path, target_path): imports that name a file of their own repository.

    Dotted modules are read as folders, both from the top and from the importing file's folder; ``./`` and ``../`` are
    taken off against that folder. Several files may answer one import; imports of other things drop out.
    """
    folder = F.regexp_extract("file_path", r"^(.*/)?[^/]*$", 1)
    parent = F.regexp_replace(folder, r"[^/]+/$", "")
    dotted = F.translate("module", ".", "/")
    written = (
        F.when(F.col("module").startswith("../"), F.array(F.concat(parent, F.substring("module", 4, 1 << 20))))
        .when(F.col("module").startswith("./"), F.array(F.concat(folder, F.substring("module", 3, 1 << 20))))
        .when(F.col("language") == "python", F.array(dotted, F.concat(folder, F.ltrim(dotted, F.lit("/")))))
        .otherwise(F.array(F.col("module"), F.concat(folder, F.col("module"))))
    )
    guesses = found.select("repo_name", "file_path", F.explode(written).alias("base")).select("repo_name", "file_path", F.explode(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda x: F.concat("base", x))).alias("target_path"))
    there = files.select("repo_name", F.col("file_path").alias("target_path")).distinct()
    return guesses.join(there, ["repo_name", "target_path"], "left_semi").where("target_path != file_path").select("repo_name", "file_path", "target_path").distinct()


def enclosing(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (rel_id, repo_name, source_file, line_number) with the smallest chunk of their file around their line; others drop out.

    An equi-join on the file with the range as its residual; a repeated row counts once.
    """
    spans = chunks.select("repo_name", F.col("file_path").alias("source_file"), F.col("id").alias("chunk_id"), "start_line", "end_line").distinct()
    around = rows.dropDuplicates(["rel_id"]).join(spans, ["repo_name", "source_file"]).where("line_number between start_line and end_line")
    return around.groupBy("rel_id").agg(F.min_by("chunk_id", F.struct(F.col("end_line") - F.col("start_line"), "start_line", "chunk_id")).alias("chunk_id"))


def parent_of_context(chunks: DataFrame) -> DataFrame:
    """(repo_name, id, parent_type, parent_name): the outermost parent in a chunk's context, where it names one."""
    first = F.split(F.split(stripped("context"), " > ")[0], ":")
    rows = chunks.select("repo_name", "id", first.alias("f")).where("size(f) = 2")
    return rows.select("repo_name", "id", F.col("f")[0].alias("parent_type"), F.col("f")[1].alias("parent_name")).distinct()
