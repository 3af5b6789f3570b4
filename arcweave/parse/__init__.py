"""Symbol extraction: one parser per language behind a registry.

``register(extension, parser)`` adds a language: a parser takes (file, text) and yields rows of
``NODE_SCHEMA`` as dictionaries. The table of parsers travels with each job, so what is registered on the
driver runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import types as T

from .lines import parse_lines
from .python import parse_python
from .braces import BRACES, parse_braces

NODE_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("qualified_name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("byte_start", T.IntegerType()), T.StructField("byte_end", T.IntegerType()),
    T.StructField("signature", T.StringType()), T.StructField("docstring", T.StringType()), T.StructField("visibility", T.StringType()),
    T.StructField("is_async", T.BooleanType()), T.StructField("is_static", T.BooleanType()), T.StructField("is_exported", T.BooleanType()), T.StructField("references", T.ArrayType(T.StringType())),
])

Parser = Callable[[str, str], Iterable[dict]]
EXTENSIONS: dict[str, Parser] = {"py": parse_python, "pyi": parse_python}
EXTENSIONS |= {ext: (lambda file, text, language=language: parse_braces(file, text, language)) for language, exts in BRACES.items() for ext in exts}
EXTENSIONS |= {ext: parse_lines for ext in ("kt", "kts", "swift", "rb", "php", "sh", "bash", "zsh")}


def register(extension: str, parser: Parser) -> None:
    EXTENSIONS[extension.lower()] = parser


def row(**own) -> dict:
    """A row with the defaults of the schema."""
    base = {"line_start": 0, "line_end": 0, "column": 0, "byte_start": 0, "byte_end": 0, "signature": None, "docstring": None, "visibility": "private", "is_async": False, "is_static": False, "is_exported": False, "references": []}
    return base | own


def parse_source(file: str, text: str, parsers: dict[str, Parser] | None = None) -> list[dict]:
    """Rows of one file, ordered by position; an empty file is an error but for a package marker."""
    parser = (EXTENSIONS if parsers is None else parsers).get(file.rsplit(".", 1)[-1].lower())
    if parser is None:
        return []
    if not text.strip():
        return [] if file.endswith("__init__.py") else [row(name="empty file", qualified_name="", kind="error", file=file)]
    try:
        return [row(**r) for r in parser(file, text)]
    except (SyntaxError, ValueError, RecursionError) as e:
        return [row(name=f"{type(e).__name__}: {e}", qualified_name="", kind="error", file=file), *(row(**r) for r in parse_lines(file, text))]
