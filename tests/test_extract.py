import pytest

from codeweave.functions.source_text import script_only
from codeweave.operators import extract
from codeweave.plans.samples import SAMPLES


def view(p):
    return {
        "functions": [(r["name"], r["is_exported"]) for r in p["functions"]], "methods": [(r["class_name"], r["name"]) for r in p["methods"]],
        "classes": [(r["name"], r["parents"], r["implements"]) for r in p["classes"]], "interfaces": [r["name"] for r in p["interfaces"]],
        "enums": [r["name"] for r in p["enums"]], "imports": [(r["source"], r["names"]) for r in p["imports"]]}


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_elements(language):
    text, want = SAMPLES[language]
    got = view(extract.parse(text, language))
    assert got == {k: want.get(k, []) for k in got}


def test_details():
    p = extract.parse(SAMPLES["typescript"][0], "typescript")
    make = next(m for m in p["methods"] if m["name"] == "make")
    assert (make["params"], make["return_type"], make["is_async"], make["is_static"]) == ("(a: string, b?: number)", "Promise<Shape>", True, True)
    assert next(c for c in p["classes"] if c["name"] == "Quiet")["is_exported"]
    assert [(e["export_type"], e["names"]) for e in p["exports"]] == [("named", ["Shape"]), ("named", ["Color"]), ("named", ["top"]), ("default", ["Quiet"]), ("re-export", ["arrow"])]
    q = extract.parse(SAMPLES["python"][0], "python")
    assert [(m["params"], m["return_type"], m["line"]) for m in q["methods"]][0] == ("(self, x: int = 1)", "bool", 6)


@pytest.mark.parametrize("text", ["", "def broken(:", "{" * 5000, "\0\0", "class", "export", "}" * 50 + "(" * 50])
@pytest.mark.parametrize("language", ["python", "typescript", "java", "rust", "go", "ruby", "php", "kotlin", "cpp"])
def test_broken_files_give_no_error(text, language):
    assert set(extract.parse(text, language)) == set(extract.KINDS)


@pytest.mark.parametrize("mode,text", [("vue", "<template>\n<p/>\n</template>\n<script>\nlet a\n</script>\n"), ("astro", "---\nlet a\n---\n<p/>\n<script>\nlet b\n</script>"), ("svelte", "x\n")])
def test_script_lines_stay(mode, text):
    out = script_only(text, mode)
    assert out.count("\n") == text.count("\n")
    assert all(x in ("", "let a", "let b") for x in out.split("\n")) and ("let a" in out) == ("let a" in text)


def test_python_with_errors():
    """An error costs its own line or statement; the rest, with its lines, is found."""
    from codeweave.operators.extract import python

    text = "import os\n\nclass A(B):\n    def good(self):\n        return 1\n    def bad(self:\n        x = = 2\n    def also(self, y): pass\n\ndef broken(:\n    pass\n\n@deco\ndef fine(a,\n         b):\n    return (a\n)\n\nprint 'old'\nfrom x import y\n"
    got = python(text)
    assert [(c["name"], c["parents"], c["line"]) for c in got["classes"]] == [("A", ["B"], 3)]
    assert {"good", "also"} <= {m["name"] for m in got["methods"]} and ("fine", 14) in [(f["name"], f["line"]) for f in got["functions"]]
    assert [i["source"] for i in got["imports"]] == ["os", "x"]
    whole = "class A:\n    def f(self): pass\n\ndef g(): pass\n"
    assert python(whole + "def (\n")["functions"] == python(whole)["functions"] and python("\x00") == python("") == python("((((")
