"""Symbols of languages with braces, by one scanner and a small grammar for each.

The scanner blanks strings and comments, matches braces, and reads declarations off the text before
each block or semicolon; calls in a function's block become its references.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: language -> file extensions
BRACES = {
    "typescript": ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts"), "rust": ("rs",), "go": ("go",), "java": ("java",), "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), "csharp": ("cs",), "dart": ("dart",),
}
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "sizeof", "new", "match", "loop", "else", "do", "try", "super", "this", "await", "throw", "func", "fn"}
_MORE = {"go": {"go", "defer", "select"}, "csharp": {"using", "lock", "when"}, "dart": {"assert"}, "java": {"assert"}}
_TYPES = {
    "typescript": [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("module", r"\bnamespace\s+(\w+)")],
    "rust": [("struct", r"\bstruct\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("interface", r"\btrait\s+(\w+)"), ("module", r"\bmod\s+(\w+)")],
    "go": [("struct", r"\btype\s+(\w+)\s+struct"), ("interface", r"\btype\s+(\w+)\s+interface")],
    "java": [("class", r"\b(?:class|record)\s+(\w+)"), ("interface", r"\b@?interface\s+(\w+)"), ("enum", r"\benum\s+(\w+)")],
    "c": [("struct", r"\bstruct\s+(\w+)\s*$"), ("enum", r"\benum\s+(\w+)\s*$"), ("struct", r"\bunion\s+(\w+)\s*$")],
    "cpp": [("class", r"\bclass\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("enum", r"\benum\s+(?:class\s+)?(\w+)"), ("module", r"\bnamespace\s+(\w+)")],
    "csharp": [("class", r"\b(?:class|record)\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("module", r"\bnamespace\s+([\w.]+)")],
    "dart": [("class", r"\bclass\s+(\w+)"), ("interface", r"\bmixin\s+(\w+)"), ("type_alias", r"\bextension\s+(\w+)"), ("enum", r"\benum\s+(\w+)")],
}
_FUNCTIONS = {
    "typescript": [r"\bfunction\s*\*?\s*(\w+)\s*[<(]", r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>\s*$"],
    "rust": [r"\bfn\s+(\w+)"], "go": [r"\bfunc\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)\s*[\[(]"],
}
_SIGNED = r"(?:^|[\s*&>])((?:\w+::)*~?\w+)\s*(?:<[^<>]*>)?\s*\([^;{}]*\)[^;{}()]*$"
_IMPORTS = {
    "typescript": r"^\s*import\s+(?:type\s+)?(?:([^'\"]+?)\s+from\s+)?['\"]([^'\"]+)['\"]", "rust": r"^\s*(?:pub\s+)?use\s+()([^;]+);", "go": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?()\"([^\"]+)\"\s*$",
    "java": r"^\s*import\s+(?:static\s+)?()([\w.*]+)\s*;", "c": r"^\s*#\s*include\s+()[<\"]([^>\"]+)[>\"]", "cpp": r"^\s*#\s*include\s+()[<\"]([^>\"]+)[>\"]", "csharp": r"^\s*using\s+()([\w.]+)\s*;", "dart": r"^\s*import\s+()['\"]([^'\"]+)['\"]",
}
#: Declarations that lines without semicolons make: language -> (kind, rule).
_LINES = {
    "typescript": [("type_alias", r"^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+(\w+)\s*(?:<[^=;{}]*>)?\s*=")],
    "go": [("module", r"^package\s+(\w+)"), ("constant", r"^const\s+(\w+)"), ("variable", r"^var\s+(\w+)"), ("type_alias", r"^type\s+(\w+)\s*=?\s*(?!struct\b|interface\b|=)[\w*\[(]")],
}
_GROUPS = {"const": "constant", "var": "variable"}
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|readonly|const|volatile|transient|mutable|inline|constexpr|late|required|override|virtual|abstract|sealed|new|extern|unsafe)\s+)*"
_VARIABLE = rf"(?:[@\[][\w.\]]+(?:\([^)]*\))?\s*)*{_MODIFIERS}[\w:<>,\[\]?. ]+?[\s*&]+(\w+\s*(?:\[\w*\]\s*)?(?:=[^,]*)?(?:,\s*\w+\s*(?:=[^,]*)?)*)"


def _stated(head: str, language: str, owners: list[tuple[str | None, str | None]]) -> list[tuple[str, str, str | None]]:
    """(kind, name, owner) of what a statement declares: aliases, constants, packages, fields, variables."""
    head = " ".join(head.split())
    inside = owners[-1][1] if owners else "top"
    if any(what == "function" for _, what in owners) or inside is None or not head:
        return []
    for kind, where, rule in {
        "rust": [("constant", "any", r"(?:pub(?:\([^)]*\))? )?(?:const|static(?: mut)?) (\w+) ?:.*"), ("type_alias", "any", r"(?:pub(?:\([^)]*\))? )?type (\w+).*")],
        "java": [("module", "top", r"package ([\w.]+)")], "csharp": [("module", "top", r"namespace ([\w.]+)")], "dart": [("module", "top", r"library ([\w.]+)")],
        "c": [("type_alias", "any", r"typedef .*?\(\s*\*\s*(\w+)\s*\).*"), ("type_alias", "any", r"typedef .*?(\w+)(?:\[\w*\])?")], "cpp": [("import", "any", r"using (?:namespace )?([\w:]+)")],
    }.get(language, []):
        found = re.fullmatch(rule, head)
        if found and where in ("any", inside):
            return [(kind, found[1], None)]
    if not (inside == "type" and language in ("java", "csharp", "cpp") or inside == "top" and language == "dart"):
        return []
    found = re.fullmatch(_VARIABLE, re.sub(r"^(?:public|private|protected)\s*:\s*", "", head))
    if not found or re.match(r"(?:return|using|import|export|part|library|throw|friend|typedef|template|delegate|event)\b", head) or "(" in re.sub(r"^(?:@\w+(?:\([^)]*\))?\s*)+", "", head).split("=")[0]:
        return []
    names = [re.match(r"\w+", x.strip())[0] for x in re.split(r",(?![^<(\[{]*[>)\]}])", found[1]) if re.match(r"\w+", x.strip())]
    owner = owners[-1][0] if inside == "type" else None
    return [("field" if owner else "variable", name, owner) for name in names]


def _blank(text: str) -> str:
    """The text with comments and strings as spaces; line ends stay."""
    rule = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n]){2,}'|`(?:\\.|[^`\\])*`"
    return re.sub(rule, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _callees(block: str, language: str) -> list[str]:
    found = set()
    for m in re.finditer(r"([A-Za-z_$][\w$]*(?:(?:\?\.|\.|::|->)[A-Za-z_$][\w$]*)*)\s*(?:<[\w, ]*>)?\(", block):
        name = m[1].replace("?.", ".").replace("->", ".")
        last = re.split(r"\.|::", name)[-1]
        if (name == last and last in _WORDS | _MORE.get(language, set())) or block[: m.start()].rstrip().endswith(("function", "fn", "func", "new")):
            continue
        if language == "typescript":
            name = re.sub(r"^(this|super)\.", "", name)
            if "." in name and not re.fullmatch(r"[A-Z][\w$]*\.[\w$]+", name):
                name = "." + last
        elif language == "dart":
            name = re.sub(r"^this\.", "", name)
            if "." in name:
                continue
        elif language == "java":
            name = ".".join(name.split(".")[-2:])
        elif language == "cpp" and "." in name:
            continue
        found.add(name)
    return sorted(found)


def parse_braces(file: str, text: str, language: str) -> Iterator[dict]:
    plain = _blank(text)
    line_of = lambda at: plain.count("\n", 0, at) + 1
    rows = []
    for m in re.finditer(_IMPORTS[language], text, re.M):
        names = []
        if language == "typescript" and m[1]:
            star = re.match(r"\*\s+as\s+(\w+)", m[1])
            names = [f"*as:{star[1]}"] if star else [x.split(" as ")[-1].strip() for x in re.sub(r"[{}]", ",", m[1]).split(",") if x.strip()]
        rows.append({"name": m[2], "qualified_name": m[2], "kind": "import", "file": file, "line_start": line_of(m.start()), "line_end": line_of(m.end()), "byte_start": m.start(), "byte_end": m.end(), "references": names})
    for kind, rule in _LINES.get(language, []):
        rows += [_row(file, m[1], m[1], kind, m.start(), m.end(), text, line_of, []) for m in re.finditer(rule, plain, re.M)]
    if language == "go":
        for group in re.finditer(r"^(const|var)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)", plain, re.M):
            rows += [_row(file, m[1], m[1], _GROUPS[group[1]], group.start(2) + m.start(1), group.start(2) + m.end(), text, line_of, []) for m in re.finditer(r"^[ \t]*(\w+)\b[^\n]*", group[2], re.M)]
    owners: list[tuple[str | None, str | None]] = []
    opened: list[tuple[int, dict | None, bool]] = []
    head_at, depth_parens, named = 0, 0, False
    join = "::" if language == "cpp" else "."
    for m in re.finditer(r"[{}();]", plain):
        c, at = m[0], m.start()
        if c in "()":
            depth_parens += 1 if c == "(" else -1
            continue
        if c == ";":
            if depth_parens <= 0:
                head = plain[head_at:at]
                if language == "c" and not any(o[1] == "function" for o in owners) and re.search(_SIGNED, head) and "=" not in head and "typedef" not in head:
                    name = re.search(_SIGNED, head)[1]
                    if name not in _WORDS:
                        rows.append(_row(file, name, name, "function", head_at, at, text, line_of, []))
                elif named and re.fullmatch(r"\s*\w+\s*", head):
                    rows.append(_row(file, head.strip(), head.strip(), "type_alias", head_at, at, text, line_of, []))
                start = head_at + len(head) - len(head.lstrip())
                for kind, name, owner in _stated(head, language, owners):
                    rows.append(_row(file, name, f"{owner}{join}{name}" if owner else name, kind, start, at, text, line_of, []))
                head_at, depth_parens, named = at + 1, 0, False
            continue
        if c == "{":
            made = _declared(plain[head_at:at], language, owners)
            start = head_at + len(plain[head_at:at]) - len(plain[head_at:at].lstrip())
            if made:  # languages without semicolons: the declaration begins on the line of its name
                start = max(start, plain.rfind("\n", 0, head_at + plain[head_at:at].rfind(made[1])) + 1)
            row = None
            if made:
                kind, name, owner = made
                if kind != "impl":
                    qualified = f"{owner}{join}{name}" if owner else name
                    row = _row(file, name.split("::")[-1], qualified, kind, start, at, text, line_of, [])
                    rows.append(row)
            owners.append((made[1], "function" if made[0] in ("function", "method", "constructor", "field") else "top" if made[0] == "module" else "type") if made else (None, None))
            opened.append((at, row, bool(re.match(r"\s*typedef\b", plain[head_at:at]))))
        elif opened:
            begin, row, named = opened.pop()
            owners.pop()
            if row is not None:
                row["line_end"], row["byte_end"] = line_of(at), at + 1
                if row["kind"] in ("function", "method"):
                    row["references"] = _callees(plain[begin : at + 1], language)
        head_at, depth_parens = at + 1, 0
    yield from sorted(rows, key=lambda r: (r["byte_start"], r["qualified_name"]))


def _row(file, name, qualified, kind, start, stop, text, line_of, references) -> dict:
    head = " ".join(text[start:stop].split())
    public = bool(re.search(r"\b(pub|public|export)\b", head)) or name[:1].isupper()
    return {"name": name, "qualified_name": qualified, "kind": kind, "file": file, "line_start": line_of(start), "line_end": line_of(stop), "byte_start": start, "byte_end": stop, "signature": head, "visibility": "public" if public else "private", "is_async": "async" in head.split(), "is_static": "static" in head.split(), "is_exported": public, "references": references}


def _declared(head: str, language: str, owners: list[tuple[str | None, str | None]]) -> tuple[str, str, str | None] | None:
    """(kind, name, owner) of the declaration that opens a block; kind impl only names the owner of what is inside."""
    head = head.strip()
    owner = next((name for name, what in reversed(owners) if what == "type"), None)
    if language == "rust":
        impl = re.search(r"\bimpl\b(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)", head)
        if impl:
            return "impl", impl[1], None
    for kind, rule in _TYPES[language]:
        # without semicolons a head reaches back to the last block: a type stands on its last line
        head = head.rsplit("\n", 1)[-1] if language == "go" and re.search(rule, head.rsplit("\n", 1)[-1]) else head
        found = re.search(rule, head)
        if found and "(" not in head[: found.start()]:
            return kind, found[1], None
    for rule in _FUNCTIONS.get(language, []):
        found = re.search(rule, head)
        if found:
            receiver = found[1] if found.re.groups == 2 else owner if language == "rust" else None
            return ("method" if receiver else "function"), found[found.re.groups], receiver
    if language == "csharp" and owners and owners[-1][1] == "type" and "(" not in head and "=" not in head:
        found = re.fullmatch(rf"(?:\[[^\]]*\]\s*)*{_MODIFIERS}[\w<>,\[\]?. ]+\s(\w+)", " ".join(head.split()))
        if found:  # a property and its accessors
            return "field", found[1], owner
    if language in _FUNCTIONS and not (language == "typescript" and owner and owners and owners[-1][1] == "type"):
        return None
    if any(what == "function" for _, what in owners):
        return None
    found = re.search(_SIGNED, head) or (re.search(r"(?:^|\s)([\w$#]+)\s*\([^{}]*\)\s*(?::[^{}]*)?$", head) if language == "typescript" else None)
    if not found or found[1].split("::")[-1] in _WORDS or "=" in head.split("(")[0]:
        return None
    name = found[1]
    if language == "cpp" and "::" in name:
        owner, name = name.rsplit("::", 1)
    if owner and name in (owner, "constructor"):
        return "constructor", name, owner
    return ("method" if owner else "function"), name, owner
