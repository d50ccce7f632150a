"""Import statements of each language as ``{source, names, kind, line}``."""

from __future__ import annotations

import ast
import re

from codeweave.functions import registry
from codeweave.functions.source_text import Layout


def row(source: str | None, names: list[str], line: int, kind: str | None = None) -> dict:
    return {"source": source, "names": names, "kind": kind, "line": line}


def python(tree: ast.AST) -> list[dict]:
    """``from x import a``: source with its dots and the names as written; ``import a, b``: the last module only."""
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out.append(row(node.names[-1].name, [], node.lineno))
        elif isinstance(node, ast.ImportFrom):
            out.append(row("." * node.level + (node.module or ""), [a.name for a in node.names if a.name != "*"], node.lineno))
    return sorted(out, key=lambda r: r["line"])


_CLAUSE = re.compile(r"\s*(?:type\s+)?(?:([^'\";()]*?)\bfrom\s*)?(['\"])(.*?)\2", re.DOTALL)
_QUOTED = re.compile(r"\s*(['\"])(.*?)\1")


def js(text: str, plain: str, lay: Layout) -> list[dict]:
    out, seen = [], set()
    for m in re.finditer(r"\bimport\b(?!\s*\()", plain):
        s = _CLAUSE.match(text, m.end())
        if not s:
            continue
        clause, names = s[1] or "", []
        if head := re.match(r"\s*([A-Za-z_$][\w$]*)", clause):
            names.append(head[1])
        if inner := re.search(r"\{([^}]*)\}", clause):
            names += [x for part in inner[1].split(",") if (x := re.sub(r"^\s*type\s+", "", part).split(" as ")[0].strip())]
        out.append(row(s[3], names, lay.line(m.start())))
    for m in re.finditer(r"(?:\b(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*)?\brequire\s*\(", plain):
        s = _QUOTED.match(text, m.end())
        if s and s[2] not in seen:
            seen.add(s[2])
            bound = m[1] or ""
            names = [x.split(":")[0].strip() for x in bound.strip("{}").split(",") if x.strip()]
            out.append(row(s[2], names, lay.line(m.start() if not m[1] else m.end() - 1)))
    return out


def java(text: str, plain: str, lay: Layout) -> list[dict]:
    out = []
    for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+?)(\.\*)?\s*;", plain, re.MULTILINE):
        out.append(row(m[1], ["*"] if m[2] else [m[1].split(".")[-1]], lay.line(m.start(1))))
    return out


def go(text: str, plain: str, lay: Layout) -> list[dict]:
    out = []
    for m in re.finditer(r"\bimport\b\s*(\()?", plain):
        end = lay.match.get(m.end() - 1, len(text)) if m[1] else (plain.find("\n", m.end()) if plain.find("\n", m.end()) >= 0 else len(plain))
        for s in re.finditer(r"([\w.]+\s+)?[\"`]([^\"`\n]+)[\"`]", text[m.end():end]):
            if plain[m.end() + s.end() - 1] not in "\"`":
                continue
            alias = (s[1] or "").strip()
            out.append(row(s[2], [alias if alias not in ("", ".", "_") else s[2].split("/")[-1]], lay.line(m.end() + s.start(2))))
    return out


def _use(tree: str, prefix: str) -> dict[str, str]:
    """Names a Rust use-tree brings, each with its full path; of one name the last stays."""
    tree = tree.strip()
    if m := re.match(r"(.*?)\{(.*)\}$", tree, re.DOTALL):
        head, out, depth, part = prefix + m[1], {}, 0, ""
        for c in m[2] + ",":
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                if part.strip():
                    out |= _use(part, head)
                part = ""
            else:
                part += c
        return out
    path, _, alias = (x.strip() for x in tree.partition(" as "))
    whole = (prefix + path).removesuffix("::self") if path == "self" else prefix + path
    if path.endswith("*"):
        whole = whole.removesuffix("*").removesuffix("::")
        return {"*" + whole: whole}
    return {alias or whole.split("::")[-1]: whole}


def rust(text: str, plain: str, lay: Layout) -> list[dict]:
    out = []
    for m in re.finditer(r"\buse\s+([^;]+);", plain):
        out += [row(source, [name], lay.line(m.start())) for name, source in _use(re.sub(r"\s+", " ", m[1]).replace(" ::", "::").replace(":: ", "::"), "").items()]
    return out


def c_sharp(text: str, plain: str, lay: Layout) -> list[dict]:
    out = []
    for m in re.finditer(r"^\s*(?:global\s+)?using\s+(?:(static)\s+|(\w+)\s*=\s*)?([\w.]+)(?:<[^;]*>)?\s*;", plain, re.MULTILINE):
        names = [m[3].split(".")[-1]] if m[1] else [m[2]] if m[2] else ["*"]
        out.append(row(m[3], names, lay.line(m.start(3))))
    return out


def kotlin(text: str, plain: str, lay: Layout) -> list[dict]:
    out = []
    for m in re.finditer(r"^\s*import\s+([\w.]+?)(\.\*)?(?:\s+as\s+(\w+))?\s*;?$", plain, re.MULTILINE):
        source = m[1]
        out.append(row(source, ["*"] if m[2] else [m[3] or source.split(".")[-1]], lay.line(m.start(1))))
    return out


def scala(text: str, plain: str, lay: Layout) -> list[dict]:
    out = []
    for m in re.finditer(r"^\s*import\s+([\w.]+?)(?:\.(_|\*)|\.\{([^}]*)\})?\s*;?$", plain, re.MULTILINE):
        line = lay.line(m.start(1))
        if m[2]:
            out.append(row(m[1], ["*"], line))
        elif m[3] is not None:
            for part in m[3].split(","):
                old, _, new = (x.strip() for x in part.replace(" as ", "=>").partition("=>"))
                if old:
                    out.append(row(m[1], ["*"], line) if old in ("_", "*") else row(f"{m[1]}.{old}", [new or old], line))
        else:
            out.append(row(m[1], [m[1].split(".")[-1]], line))
    return out


def dart(text: str, plain: str, lay: Layout) -> list[dict]:
    return [row(s[2], [], lay.line(m.start())) for m in re.finditer(r"\b(?:import|export)\s+(?=['\"])", plain) if (s := re.match(r"(['\"])(.*?)\1", text[m.end():m.end() + 500]))]


def swift(text: str, plain: str, lay: Layout) -> list[dict]:
    out = []
    for m in re.finditer(r"^\s*(?:@\w+\s+)?import\s+(?:(?:class|struct|enum|protocol|func|var|let|typealias)\s+)?([\w.]+)", plain, re.MULTILINE):
        parts = m[1].split(".")
        out.append(row(parts[0], [parts[-1]] if len(parts) > 1 else [], lay.line(m.start(1))))
    return out


def php(text: str, plain: str, lay: Layout) -> list[dict]:
    out = []
    for m in re.finditer(r"^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)(?:\{([^}]*)\})?(?:\s+as\s+\w+)?\s*;", plain, re.MULTILINE):
        line = lay.line(m.start(1))
        if m[2] is not None:
            out += [row(m[1].rstrip("\\") + "\\" + p, [p.split("\\")[-1]], line) for part in m[2].split(",") if (p := part.split(" as ")[0].strip())]
        else:
            out.append(row(m[1].lstrip("\\"), [m[1].split("\\")[-1]], line))
    seen = set()
    for m in re.finditer(r"\b((?:require|include)(?:_once)?)\s*\(?\s*(?:__DIR__\s*\.\s*)?(?=['\"])", plain):
        if (s := re.match(r"(['\"])(.*?)\1", text[m.end():m.end() + 500])) and s[2] not in seen:
            seen.add(s[2])
            rel = "." + s[2] if "__DIR__" in m[0] and s[2].startswith("/") else s[2]
            out.append(row(rel, [], lay.line(m.start()), m[1] if m[1] != "require" else None))
    return out


def ruby(text: str, plain: str, lay: Layout) -> list[dict]:
    out, seen = [], set()
    for m in re.finditer(r"^\s*(require_relative|require|load)\s*\(?\s*(?=['\"])", plain, re.MULTILINE):
        if (s := re.match(r"(['\"])(.*?)\1", text[m.end():m.end() + 500])) and s[2] not in seen:
            seen.add(s[2])
            out.append(row(s[2], [], lay.line(m.start(1)), None if m[1] == "require" else m[1]))
    return out


def c(text: str, plain: str, lay: Layout) -> list[dict]:
    out = []
    for m in re.finditer(r"^[ \t]*#[ \t]*include[ \t]*(<([^>\n]+)>|\"([^\"\n]+)\")", text, re.MULTILINE):
        out.append(row(m[2] or m[3], [], lay.line(m.start(1)), "system" if m[2] else "local"))
    return out


def generic(text: str, plain: str, lay: Layout) -> list[dict]:
    """Any ``import`` with a string or a dotted name, for languages without rules of their own."""
    out = []
    for m in re.finditer(r"^\s*import\s+(?:(['\"])(.*?)\1|([\w.]+))", text, re.MULTILINE):
        out.append(row(m[2] or m[3], [], lay.line(m.start())))
    return out


_BY_LANGUAGE = dict.fromkeys(registry.JS_FAMILY, js) | {
    "java": java, "go": go, "rust": rust, "c_sharp": c_sharp, "kotlin": kotlin, "scala": scala, "dart": dart, "swift": swift, "php": php, "c": c, "cpp": c}


def extract(text: str, plain: str, language: str, lay: Layout) -> list[dict]:
    return _BY_LANGUAGE.get(language, generic)(text, plain, lay)
