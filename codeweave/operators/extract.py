"""Structural extraction: files to elements, imports and exports.

Python goes through its own parser; brace languages through bracket matching on text whose comments and strings are blanked,
with declaration patterns for each language; Ruby through a scanner of its block words. All kinds of a file come out of one
``mapInPandas`` stage as one struct and are exploded from there. A file that cannot be parsed gives no elements.

Supported constructs are listed in the README; where a construct needs a full grammar (macros, conditional compilation, unusual
layouts) it may be missed, and nothing fails.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.functions import registry
from codeweave.functions.source_text import Layout, blanked, script_only
from codeweave.operators import imports as imp

KINDS = {
    "functions": "name string, params string, return_type string, is_async boolean, is_exported boolean, line int, end_line int",
    "methods": "name string, class_name string, params string, return_type string, is_static boolean, is_abstract boolean, is_async boolean, visibility string, line int, end_line int",
    "classes": "name string, parents array<string>, implements array<string>, is_abstract boolean, is_exported boolean, line int, end_line int",
    "interfaces": "name string, extends array<string>, properties array<string>, is_exported boolean, line int",
    "enums": "name string, members array<string>, is_const boolean, is_exported boolean, line int",
    "imports": "source string, names array<string>, kind string, line int",
    "exports": "export_type string, names array<string>, source string, line int",
}
SCHEMA = "path string, language string, parse_order long, mode string, " + ", ".join(f"{k} array<struct<{', '.join(x.replace(' ', ':', 1) for x in v.split(', '))}>>" for k, v in KINDS.items())


def empty() -> dict[str, list]:
    return {k: [] for k in KINDS}


def tidy(params: str) -> str | None:
    return " ".join(params.split())[:300] or None


def base(name: str) -> str:
    return name.split("<")[0].strip()


# Python --------------------------------------------------------------------------------------------------------------

#: A line that begins a statement of a module; closing brackets, comments and strings go on with the one before.
_TOP = re.compile(r"^(?=[A-Za-z_@])(?!(?:else|elif|except|finally)\b)", re.MULTILINE)


def python_tree(text: str) -> ast.Module:
    """The syntax tree of a module; where it has errors, that of what is left without the lines they are on.

    Statements of the module are parsed one by one then, so an error costs its own statement at most. In one that fails, the line of
    the error becomes ``pass``, then empty, until the rest can be read or no further line can be given up.
    """
    try:
        return ast.parse(text)
    except (ValueError, RecursionError):
        return ast.Module([], [])
    except SyntaxError:
        pass
    starts = [m.start() for m in _TOP.finditer(text)]
    # decorators belong to what they decorate
    starts = [0, *(x for prev, x in zip([None, *starts], starts) if x and not (prev is not None and text[prev] == "@"))]
    body: list[ast.stmt] = []
    for x, y in zip(starts, [*starts[1:], len(text)]):
        lines, above = text[x:y].split("\n"), text.count("\n", 0, x)
        while True:
            try:
                part = ast.parse("\n".join(lines))
            except SyntaxError as e:
                at = (e.lineno or 0) - 1
                if not 0 <= at < len(lines) or not (held := lines[at].strip()):
                    break
                lines[at] = "" if held == "pass" else lines[at][:len(lines[at]) - len(lines[at].lstrip())] + "pass"
            except (ValueError, RecursionError):
                break
            else:
                body += [ast.increment_lineno(n, above) for n in part.body]
                break
    return ast.Module(body, [])


def python(text: str) -> dict[str, list]:
    out, tree = empty(), python_tree(text)
    lines = text.split("\n")

    def segment(a_line: int, a_col: int, b_line: int, b_col: int) -> str:
        part = [x.encode() for x in lines[a_line - 1:b_line]]
        part[-1] = part[-1][:b_col]
        part[0] = part[0][a_col:]
        return b"\n".join(part).decode("utf-8", "replace")

    def signature(node) -> str | None:
        head = segment(node.lineno, node.col_offset, node.body[0].lineno, node.body[0].col_offset) if node.body else ""
        m = Layout(blanked(head, "python").replace("#", " "))
        at = head.find("(", head.find(node.name))
        return tidy(head[at:m.match[at] + 1]) if at in m.match else None

    def visit(node, classes: list[str], in_class_body: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                parents = [ast.unparse(b) for b in child.bases if isinstance(b, (ast.Name, ast.Attribute))]
                out["classes"].append({"name": child.name, "parents": parents, "implements": [], "is_abstract": False, "is_exported": not child.name.startswith("_"), "line": child.lineno, "end_line": child.end_lineno})
                visit(child, [*classes, child.name], True)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                row = {"name": child.name, "params": signature(child), "return_type": ast.get_source_segment(text, child.returns) if child.returns else None,
                       "is_async": isinstance(child, ast.AsyncFunctionDef), "line": child.lineno, "end_line": child.end_lineno}
                if in_class_body:
                    out["methods"].append(row | {"class_name": classes[-1], "is_static": False, "is_abstract": False, "visibility": "public"})
                elif not classes:
                    out["functions"].append(row | {"is_exported": not child.name.startswith("_")})
                visit(child, classes, False)
            else:
                visit(child, classes, False)

    visit(tree, [], False)
    out["imports"] = imp.python(tree)
    return out


# Brace languages -----------------------------------------------------------------------------------------------------

_ID = r"[A-Za-z_$][\w$]*"
_NOT_NAMES = set("if for while switch catch return function do else try new throw typeof await yield case delete in of with sizeof using lock foreach match when super this assert elseif unless until print".split())

#: Per language: types (kind, pattern with name, and whether members of their body are methods), functions, and members.
_TYPES = {
    "js": [("class", rf"\b(?P<abs>abstract\s+)?class\s+(?P<name>(?!extends\b){_ID})", True), ("interface", rf"\binterface\s+(?P<name>{_ID})", False), ("enum", rf"\b(?P<const>const\s+)?enum\s+(?P<name>{_ID})", True)],
    "go": [("class", r"\btype\s+(?P<name>\w+)(?:\[[^\]\n]*\])?\s+struct\b", False), ("interface", r"\btype\s+(?P<name>\w+)(?:\[[^\]\n]*\])?\s+interface\b", False)],
    "rust": [("class", r"\bstruct\s+(?P<name>\w+)", False), ("interface", r"\btrait\s+(?P<name>\w+)", False), ("enum", r"\benum\s+(?P<name>\w+)", False)],
    "java": [("class", r"\b(?P<abs>abstract\s+(?:\w+\s+)*)?class\s+(?P<name>\w+)", True), ("interface", r"(?<!@)\binterface\s+(?P<name>\w+)", False), ("enum", r"\benum\s+(?P<name>\w+)", True)],
    "c_sharp": [("class", r"\b(?P<abs>abstract\s+(?:\w+\s+)*)?class\s+(?P<name>\w+)", True), ("interface", r"\binterface\s+(?P<name>\w+)", False), ("enum", r"\benum\s+(?P<name>\w+)", True)],
    "kotlin": [("enum", r"\benum\s+class\s+(?P<name>\w+)", True), ("class", r"(?<!enum )\b(?P<abs>abstract\s+(?:\w+\s+)*)?class\s+(?P<name>\w+)", True), ("class", r"(?<!companion )\bobject\s+(?P<name>\w+)", True), ("interface", r"\binterface\s+(?P<name>\w+)", True)],
    "scala": [("class", r"\b(?P<abs>abstract\s+)?class\s+(?P<name>\w+)", True), ("class", r"\bobject\s+(?P<name>\w+)", True), ("interface", r"\btrait\s+(?P<name>\w+)", True)],
    "dart": [("class", r"\b(?P<abs>abstract\s+(?:\w+\s+)*)?class\s+(?P<name>\w+)", True), ("enum", r"\benum\s+(?P<name>\w+)", True)],
    "swift": [("class", r"(?<!import )\bclass\s+(?!func\b|var\b)(?P<name>\w+)", True), ("class", r"(?<!import )\bstruct\s+(?P<name>\w+)", True), ("interface", r"\bprotocol\s+(?P<name>\w+)", False), ("enum", r"\benum\s+(?P<name>\w+)", True)],
    "php": [("class", r"\b(?P<abs>abstract\s+(?:\w+\s+)*)?(?<!:)class\s+(?P<name>\w+)", True), ("class", r"\btrait\s+(?P<name>\w+)", True), ("interface", r"\binterface\s+(?P<name>\w+)", False), ("enum", r"\benum\s+(?P<name>\w+)", True)],
    "c": [("enum", r"\benum\s+(?P<name>\w+)(?=\s*\{)", False)],
    "cpp": [("class", r"\b(?<!enum )(?:class|struct)\s+(?P<name>\w+)(?=[^;(){}=]*\{)", True), ("enum", r"\benum\s+(?:class\s+|struct\s+)?(?P<name>\w+)(?=[^;{]*\{)", False)],
}
_GENERIC = r"(?:\s*<[^<>(){}]*(?:<[^<>]*>[^<>(){}]*)*>)?"
_CALLABLES = {
    "js": rf"(?:\b(?P<async>async\s+)?function\s*\*?\s*(?P<f>{_ID}){_GENERIC}\s*(?P<fo>\()|\b(?:const|let|var)\s+(?P<v>{_ID})\s*(?::[^=;\n]+)?=\s*(?P<vasync>async\s+)?(?:function\s*\*?\s*(?:{_ID})?\s*)?(?P<vo>\()|(?:(?<=[;{{}}\n*/])|^)[ \t]*(?P<mods>(?:(?:public|private|protected|static|abstract|async|readonly|override|get|set)\s+)*)\*?\s*(?P<m>\#?{_ID}){_GENERIC}\s*(?P<mo>\())",
    "go": r"\bfunc\s*(?:(?P<recv>\([^()]*\))\s*)?(?P<f>\w+)(?:\[[^\]\n]*\])?\s*(?P<fo>\()",
    "rust": rf"\b(?P<async>async\s+)?(?:unsafe\s+)?(?:extern\s+\S+\s+)?fn\s+(?P<f>\w+){_GENERIC}\s*(?P<fo>\()",
    "java": r"(?P<mods>(?:(?:public|private|protected|static|abstract|final|synchronized|native|default|strictfp)\s+)*)(?:<[^<>(){};]*>\s*)?(?P<ret>[A-Za-z_][\w.]*(?:\s*<[^(){};]*>)?(?:\s*\[\s*\])*)\s+(?P<f>\w+)\s*(?P<fo>\()",
    "c_sharp": r"(?P<mods>(?:(?:public|private|protected|internal|static|abstract|virtual|override|sealed|async|extern|partial|new|unsafe|readonly)\s+)*)(?P<ret>[A-Za-z_][\w.]*(?:\s*<[^(){};]*>)?(?:\s*\[\s*\])*\??)\s+(?P<f>\w+)" + _GENERIC + r"\s*(?P<fo>\()",
    "kotlin": r"(?P<mods>(?:(?:public|private|protected|internal|abstract|open|override|suspend|inline|operator|infix|tailrec|final)\s+)*)\bfun\s+(?:<[^<>]*>\s*)?(?:[\w.<>?]+\.)?(?P<f>\w+)\s*(?P<fo>\()",
    "scala": r"(?P<mods>(?:(?:private|protected|override|final|implicit|abstract|lazy)(?:\[\w+\])?\s+)*)\bdef\s+(?P<f>\w+)(?:\s*\[[^\]]*\])?\s*(?P<fo>\()?",
    "dart": r"(?P<mods>(?:(?:static|external|abstract|final|const)\s+)*)(?P<ret>[A-Za-z_][\w.]*(?:<[^(){};]*>)?\??)\s+(?:get\s+|set\s+)?(?P<f>\w+)\s*(?P<fo>\()",
    "swift": r"(?P<mods>(?:(?:public|private|fileprivate|internal|open|static|class|override|final|mutating|async)\s+)*)\bfunc\s+(?P<f>\w+)" + _GENERIC + r"\s*(?P<fo>\()",
    "php": r"(?P<mods>(?:(?:public|private|protected|static|abstract|final)\s+)*)\bfunction\s+&?\s*(?P<f>\w+)\s*(?P<fo>\()",
    "c": r"(?:(?<=[;}\n])|^)[ \t]*(?P<mods>(?:static\s+|inline\s+|extern\s+)*)(?P<ret>[A-Za-z_][\w\s*]*?[\s*])(?P<f>[A-Za-z_]\w*)\s*(?P<fo>\()",
    "cpp": r"(?:(?<=[;}:{\n])|^)[ \t]*(?P<mods>(?:static\s+|inline\s+|virtual\s+|explicit\s+|constexpr\s+|extern\s+)*)(?P<ret>[A-Za-z_][\w\s:*&<>,]*?[\s*&])(?:(?P<q>\w+)::)?(?P<f>~?[A-Za-z_]\w*)\s*(?P<fo>\()",
}
_FAMILY = dict.fromkeys(registry.JS_FAMILY, "js")
_COMPILED: dict[str, tuple] = {}


def _patterns(family: str):
    if family not in _COMPILED:
        _COMPILED[family] = ([(k, re.compile(p), own) for k, p, own in _TYPES[family]], re.compile(_CALLABLES[family], re.MULTILINE))
    return _COMPILED[family]


def heritage(language: str, head: str) -> tuple[list[str], list[str]]:
    """(parents, implemented) of a class from what stands between its name and its body."""
    flat = head
    for _ in range(6):
        flat = re.sub(r"<[^<>]*>", "", flat)
    split = lambda s: [base(x) for x in s.split(",") if re.match(r"[\w$.\\:]", x.strip())]
    after = lambda word, stop: split(m[1]) if (m := re.search(rf"\b{word}\b(.*?)(?:{stop}|$)", flat, re.DOTALL)) else []
    if language in registry.JS_FAMILY:
        return after("extends", r"\bimplements\b|\{")[:1], after("implements", r"\{")
    if language in ("java", "php"):
        return after("extends", r"\bimplements\b|\bpermits\b|\{")[:1], after("implements", r"\bpermits\b|\{")
    if language == "dart":
        return after("extends", r"\bwith\b|\bimplements\b|\{")[:1], after("implements", r"\{")
    if language == "scala":
        return [x for part in re.split(r"\bwith\b", (re.search(r"\bextends\b(.*)", re.sub(r"\([^()]*\)", "", flat), re.DOTALL) or ["", ""])[1]) if (x := base(part)) and re.match(r"\w", x)], []
    if language in ("c_sharp", "swift"):
        m = re.search(r":(.*)", re.split(r"\bwhere\b", flat)[0], re.DOTALL)
        return (split(m[1]) if m else []), []
    if language == "cpp":
        m = re.search(r":(.*)", flat, re.DOTALL)
        return ([x for part in (m[1].split(",") if m else []) if (x := re.sub(r"\b(public|private|protected|virtual)\b", "", part).strip())]), []
    if language == "kotlin":
        m = re.search(r":(.*)", re.sub(r"^\s*(?:\w+\s+)*\(.*?\)(?=\s*(?::|$))", "", flat, flags=re.DOTALL), re.DOTALL)
        parts, depth, word = [], 0, ""
        for c in (m[1] if m else "") + ",":
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                parts.append(word.strip())
                word = ""
            else:
                word += c
        return [p.split("(")[0].strip() for p in parts if "(" in p], [base(p) for p in parts if p and "(" not in p]
    return [], []


def _exported(language: str, name: str, before: str) -> bool:
    """Visibility outside the file by each language's own rule; ``before``: the words ahead of the declaration."""
    words = set(re.findall(r"\w+", before))
    if language == "go":
        return name[:1].isupper()
    if language == "dart":
        return not name.startswith("_")
    if language == "rust":
        return "pub" in words
    if language == "java":
        return "public" in words
    if language == "c_sharp":
        return "public" in words or not words & {"private", "protected", "internal", "static", "abstract", "sealed", "partial"}
    if language in ("c", "cpp"):
        return "static" not in words
    return not words & {"private", "internal", "fileprivate"}


def braces(text: str, language: str) -> dict[str, list]:
    out = empty()
    family = _FAMILY.get(language, language)
    plain = blanked(text, language)
    lay = Layout(plain)
    types, callable_ = _patterns(family)
    bodies: dict[int, tuple[str, bool]] = {}  # start of a body -> name of the type, members are methods
    shown: list[tuple[int, int]] = []         # ranges below an export
    if family == "js":
        for m in re.finditer(r"\bexport\b", plain):
            o = plain.find("{", m.end())
            stop = plain.find(";", m.end())
            end = lay.match.get(o, o) if o >= 0 and (stop < 0 or o < stop) else (stop if stop >= 0 else len(plain))
            shown.append((m.start(), end if end >= 0 else len(plain)))
    is_shown = lambda at: any(a <= at <= b for a, b in shown)
    start_of = lambda at: max(plain.rfind(c, 0, at) for c in ";{}") + 1

    found = []
    for kind, pattern, own in types:
        found += [(m.start(), kind, m, own) for m in pattern.finditer(plain)]
    for at, kind, m, own in sorted(found, key=lambda x: x[0]):
        name, o = m["name"], plain.find("{", m.end())
        stop = plain.find(";", m.end())
        if o >= 0 and stop >= 0 and stop < o and language not in ("kotlin", "scala", "swift"):
            o = -1
        if language in ("kotlin", "scala") and o >= 0 and re.search(r"\n\s*(?:\w+\s+)*(?:class|object|trait|interface|fun|def|val|var)\b", plain[m.end():o]):
            o = -1
        end = lay.match.get(o) if o >= 0 else None
        before = plain[start_of(at):at]
        groups = m.groupdict()
        public = is_shown(at) if family == "js" else _exported(language, name, before + (groups.get("abs") or ""))
        line = lay.line(m.start("name"))
        if end is not None:
            bodies[o] = (name, own)
        head = plain[m.end():o if o >= 0 else m.end()]
        if kind == "class":
            parents, implements = heritage(language, head)
            if family == "js" and re.search(r"\b(?:module\.)?exports\s*=\s*$", plain[:at]):
                public = True
            out["classes"].append({"name": name, "parents": parents, "implements": implements, "is_abstract": bool(groups.get("abs")), "is_exported": public, "line": line, "end_line": lay.line(end) if end else line})
        elif kind == "interface":
            inner = plain[o + 1:end] if end else ""
            props = re.findall(rf"^\s*(?:readonly\s+)?({_ID})\??\s*:", inner, re.MULTILINE) if family == "js" else []
            extends = [base(x) for x in re.findall(r"\bextends\b([^{]*)", head) for x in x.split(",")] if family == "js" else []
            out["interfaces"].append({"name": name, "extends": extends, "properties": props, "is_exported": public, "line": line})
        else:
            inner = plain[o + 1:end] if end else ""
            members = [x for part in inner.split(",") if (x := (re.match(rf"\s*({_ID})", part) or ["", ""])[1])] if family == "js" else []
            out["enums"].append({"name": name, "members": members, "is_const": bool(groups.get("const")), "is_exported": public, "line": line})
    if language == "rust":
        for m in re.finditer(r"\bimpl\b(?:\s*<[^{};]*?>)?\s+(?:(?P<trait>[\w:]+)(?:<[^{}]*?>)?\s+for\s+)?(?P<type>[\w:]+)[^{};]*\{", plain):
            bodies[m.end() - 1] = (m["type"].split("::")[-1], True)
            if m["trait"] and lay.around(m.start()) is None:
                for c in out["classes"]:
                    if c["name"] == m["type"]:
                        c["implements"].append(m["trait"])

    for m in callable_.finditer(plain):
        g = m.groupdict()
        name = next((g[k] for k in ("f", "v", "m") if g.get(k)), None)
        if not name or name in _NOT_NAMES or (g.get("ret") or "").strip().split(" ")[-1] in _NOT_NAMES | {"else", "public"}:
            continue
        key = "f" if g.get("f") else "v" if g.get("v") else "m"
        o = m.start(key + "o") if g.get(key + "o") else -1
        close = lay.match.get(o, -1) if o >= 0 else m.end()
        if close < 0:
            continue
        rest = plain[close + 1 if o >= 0 else close:]
        tail = re.match(r"[^{};=]*(?:=>)?" if family != "js" else r"\s*(?::\s*(?:\{[^{}]*\})?[^{};=]*)?(?:=>)?", rest)[0]
        nxt = rest[len(tail):].lstrip()[:1]
        if key == "v" and "=>" not in tail and "function" not in m[0]:
            continue
        if key == "m" and nxt not in ("{", ";"):
            continue
        block = lay.around(m.start(key))
        here = bodies.get(block) if block is not None else None
        enclosed, up = False, block
        while up is not None:
            enclosed |= up in bodies and bodies[up][1]
            up = lay.parent[up]
        if key == "m" and not (here and here[1]):
            continue
        if key == "m" and nxt == ";" and "abstract" not in (g.get("mods") or ""):
            continue
        if language in ("java", "c_sharp", "dart", "cpp", "c") and key == "f" and nxt not in ("{", ";", "=", "") and "=>" not in tail and language != "cpp":
            continue
        if language in ("java", "c_sharp", "c", "cpp", "dart") and block is not None and block not in bodies and not _namespace(plain, block):
            continue  # a call inside a body
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        open_ = close + 1 + len(tail) + (len(rest[len(tail):]) - len(rest[len(tail):].lstrip())) if nxt == "{" else -1
        end = lay.match.get(open_, close) if open_ >= 0 else close
        words = (g.get("mods") or "") + " " + plain[start_of(begin):begin]
        ret = (g.get("ret") or "").strip() or None
        if ret is None:
            said = tail.replace("=>", "").strip()
            ret = re.split(r"\bwhere\b|\bthrows\b|\n", said)[0].strip().lstrip(":-> ").strip() or None
        params = tidy(text[o:close + 1]) if o >= 0 else None
        is_async = bool(g.get("async") or g.get("vasync") or re.search(r"\basync\b", g.get("mods") or "") or (language == "rust" and "async" in words.split()))
        row = {"name": name, "params": params, "return_type": ret, "is_async": is_async, "line": lay.line(m.start(key)), "end_line": lay.line(end)}
        owner = here[0] if here and here[1] else None
        if language == "go" and g.get("recv"):
            owner = (re.findall(r"(\w+)(?:\[[^\]]*\])?\s*\)$", g["recv"]) or [None])[0]
        if g.get("q"):
            owner = g["q"]
        in_interface = here is not None and not here[1]
        as_method = owner is not None or (in_interface and language in ("java", "c_sharp", "php", "dart"))
        if as_method:
            vis = next((v for v in ("private", "protected", "public") if re.search(rf"\b{v}\b", words)), "private" if name.startswith("#") else "public")
            out["methods"].append({k: row[k] for k in ("name", "params", "return_type", "is_async", "line", "end_line")} | {
                "class_name": owner, "is_static": bool(re.search(r"\bstatic\b", words)), "is_abstract": bool(re.search(r"\babstract\b", words)), "visibility": vis})
        elif not enclosed and key != "m":
            public = is_shown(begin) if family == "js" else _exported(language, name, words)
            out["functions"].append(row | {"is_exported": public})
    out["imports"] = imp.extract(text, plain, language, lay)
    if family == "js":
        out["exports"] = _js_exports(text, plain, lay)
        default = {n for e in out["exports"] if e["export_type"] == "default" for n in e["names"]}
        for k in ("functions", "classes"):
            for row in out[k]:
                row["is_exported"] |= row["name"] in default
    return out


def _namespace(plain: str, block: int) -> bool:
    return bool(re.search(r"\b(?:namespace\b[^;{}]*|extern\s+\"[^\"]*\"\s*)$", plain[max(0, block - 200):block]))


_EXPORT_LIST = re.compile(r"\s*(?:type\s+)?(\*(?:\s*as\s+\w+)?|\{[^}]*\})\s*(?:from\s*(['\"])(.*?)\2)?")
_EXPORT_DEFAULT = re.compile(rf"\s*default\s+(?:(?:async\s+)?(?:function\s*\*?|class|abstract\s+class)\s+)?({_ID})?")
_EXPORT_NAMED = re.compile(rf"\s*(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:const\s+enum|function\s*\*?|class|interface|enum|type)\s+({_ID})")


def _js_exports(text: str, plain: str, lay: Layout) -> list[dict]:
    out = []
    for m in re.finditer(r"\bexport\b", plain):
        at, line = m.end(), lay.line(m.start())
        source = None
        if s := _EXPORT_LIST.match(text, at):
            source = s[3]
            names = [x.split(" as ")[0].strip() for x in s[1].strip("{}").split(",") if x.strip()] if s[1].startswith("{") else []
            kind = "re-export" if source else "namespace" if s[1].startswith("*") else "named"
            if names or s[1].startswith("*"):
                out.append({"export_type": kind, "names": names, "source": source, "line": line})
        elif s := _EXPORT_DEFAULT.match(text, at):
            if s[1] and s[1] not in ("function", "class", "async", "new"):
                out.append({"export_type": "default", "names": [s[1]], "source": None, "line": line})
        elif s := _EXPORT_NAMED.match(text, at):
            out.append({"export_type": "named", "names": [s[1]], "source": None, "line": line})
    return out


# Ruby ----------------------------------------------------------------------------------------------------------------

_RUBY = re.compile(r"^[ \t]*(?:(?P<type>class|module)\s+(?P<name>[A-Z][\w:]*)(?:\s*<\s*(?P<parent>[\w:]+))?|(?P<singleton>class\s*<<)|(?P<def>def)\s+(?P<self>self\.)?(?P<method>[\w?!=\[\]+\-*/<>]+)[ \t]*(?P<params>\([^)]*\))?|(?P<open>(?:if|unless|while|until|case|begin|for)\b))|(?P<do>\bdo\b(?:\s*\|[^|]*\|)?[ \t]*$)|(?P<assign>=[ \t]*(?:if|case|begin|unless)\b)|(?P<end>^[ \t]*end\b)|(?P<private>^[ \t]*(?:private|protected|public)[ \t]*$)", re.MULTILINE)


_ENDLESS = re.compile(r"[ \t]*=[^=~]")


def ruby(text: str) -> dict[str, list]:
    out, plain = empty(), blanked(text, "ruby")
    lay = Layout("")
    lay.starts = [0, *(m.end() for m in re.finditer("\n", plain))]
    stack: list[tuple[str, dict | None]] = []
    for m in _RUBY.finditer(plain):
        line = lay.line(m.start() + len(m[0]) - len(m[0].lstrip()))
        if m["end"]:
            if stack:
                kind, row = stack.pop()
                if row:
                    row["end_line"] = line
            continue
        if m["private"]:
            continue
        owner = next((r["name"] for k, r in reversed(stack) if k == "type" and r), None)
        row = None
        if m["type"]:
            row = {"name": m["name"], "parents": [m["parent"]] if m["parent"] else [], "implements": [], "is_abstract": False, "is_exported": True, "line": line, "end_line": line}
            out["classes"].append(row)
            stack.append(("type", row))
        elif m["def"]:
            common = {"name": m["method"], "params": tidy(m["params"] or ""), "return_type": None, "is_async": False, "line": line, "end_line": line}
            if stack and stack[-1][0] in ("type", "single"):
                row = common | {"class_name": owner, "is_static": bool(m["self"]), "is_abstract": False, "visibility": "public"}
                out["methods"].append(row)
            elif owner is None:
                row = common | {"is_exported": True}
                out["functions"].append(row)
            endless = _ENDLESS.match(plain, m.end())
            if not endless and not re.search(r";\s*end\b", plain[m.end():plain.find("\n", m.end()) if "\n" in plain[m.end():] else None]):
                stack.append(("def", row))
        else:
            rest = plain[m.end():plain.find("\n", m.end()) if plain.find("\n", m.end()) >= 0 else len(plain)]
            if not re.search(r"\bend\s*$", rest):
                stack.append(("single" if m["singleton"] else "block", None))
    out["imports"] = imp.ruby(text, plain, lay)
    return out


# The operator --------------------------------------------------------------------------------------------------------

def parse(content: str, language: str) -> dict[str, list]:
    """Elements of one file; component files are reduced to their scripts first."""
    try:
        if language in registry.SCRIPT_MODES:
            content = script_only(content, language)
        if language == "python":
            return python(content)
        if language == "ruby":
            return ruby(content)
        if _FAMILY.get(language, language) in _TYPES:
            return braces(content, language)
    except RecursionError:
        pass
    return empty()


def extract(files: DataFrame) -> DataFrame:
    """``files(path, language, parse_order, content, mode)`` to one row a file with an array of structs for each kind."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parsed = [parse(c or "", lang) if mode == "full" else empty() for c, lang, mode in zip(frame["content"], frame["language"], frame["mode"])]
            out = frame[["path", "language", "parse_order", "mode"]].copy()
            for k in KINDS:
                out[k] = [p[k] for p in parsed]
            yield out

    return files.select("path", "language", "parse_order", "content", "mode").mapInPandas(run, SCHEMA)


def records(parsed: DataFrame) -> dict[str, DataFrame]:
    """The parsed files as one table a kind, each with ``file_path``."""
    out = {k: parsed.select(F.col("path").alias("file_path"), "language", "parse_order", F.posexplode(k).alias("pos", "e")).select("file_path", "language", "parse_order", "pos", "e.*") for k in KINDS}
    out["files"] = parsed.select("path", "language")
    return out
