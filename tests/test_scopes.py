import pytest

from tessera.operators import graph
from tessera.operators.scopes import blank, braced, indented, scope_search, with_scopes

FILES = "repo_id string, file_path string, language string, content string"
CODE = {
    "a.rs": ("rust", 'use x;\n// fn not_this() {}\npub struct P;\npub struct Q {\n    a: u8,\n}\nimpl Q {\n    /* fn nor_this() {\n    } */\n    pub fn new(c: char) -> Q {\n        let s = "fn or_this() { ";\n        let r = r#"}} fn "that" {"#;\n        if c == \'{\' { Q { a: 1 } } else { Q { a: 2 } }\n    }\n}\npub async fn run<\'a>(x: &\'a str)\nwhere\n    u8: Copy,\n{\n    go(x);\n}\n'),
    "b.py": ("python", 'class A:\n    """\n    def hidden(self):\n        pass\n    """\n\n    def shown(\n        self,\n        a=(1,\n           2),\n    ):\n        # def no(): pass\n        x = "class B:"\n\n        def inner():\n            return call(x)\n\n        return inner\n\n    b = 1\n\n\ndef one(): return 2\nasync def last():\n    if x:\n        y()\n'),
    "c.js": ("javascript", "const t = `function nope() { ${1} }`\nexport function yes(a) {\n  // }\n  return '}' + \"{\"\n}\nclass K {\n  m() { yes(1); for (let i = 0; i < 3; i++) { no() } }\n}\nconst f = (a) => {\n  return a\n}\nconst g = async x => x\n"),
    "d.go": ("go", 'package m\n\ntype T struct {\n\ta int\n}\n\nfunc (t *T) Do() error {\n\ts := `func fake() {`\n\treturn run("}")\n}\n\nfunc Open() {\n\tdefer func() { recover() }()\n}\n'),
    "E.java": ("java", 'package p;\n\n@Service\npublic class E {\n    /** class Doc { */\n    private char c = \'{\';\n    String s = """\n        class Text {\n        """;\n\n    @Override\n    public String get(int a)\n    {\n        return "public class X {";\n    }\n\n    public static void main(String[] args) { get(1); }\n}\n'),
}
WANT = {
    "a.rs": [("P", "struct", 3, 3, None), ("Q", "struct", 4, 6, None), ("new", "method", 10, 14, None), ("run", "function", 16, 21, None)],
    "b.py": [("A", "class", 1, 20, None), ("shown", "method", 7, 18, "A"), ("inner", "function", 15, 16, "shown"), ("one", "function", 23, 23, None), ("last", "function", 24, 26, None)],
    "c.js": [("yes", "function", 2, 5, None), ("K", "class", 6, 8, None), ("f", "function", 9, 11, None), ("g", "function", 12, 12, None)],
    "d.go": [("T", "type", 3, 5, None), ("Do", "method", 7, 10, None), ("Open", "function", 12, 14, None)],
    "E.java": [("E", "class", 4, 18, None), ("get", "method", 12, 15, "E"), ("main", "method", 17, 17, "E")],
}


def files_of(spark):
    return spark.createDataFrame([("r", p, lang, text) for p, (lang, text) in CODE.items()], FILES)


@pytest.mark.parametrize("path", sorted(CODE))
def test_declarations_have_their_ends_and_none_is_in_comments_or_strings(spark, path):
    df = files_of(spark).filter(f"file_path = '{path}'")
    got = [(r["name"], r["kind"], r["line_no"], r["end_line"], r["parent"]) for r in graph.extract_symbols(df).orderBy("line_no").collect()]
    assert got == WANT[path]


def test_blanks_keep_the_shape(spark):
    for path, (language, text) in CODE.items():
        masked = blank(text, language)
        assert len(masked) == len(text) and [len(x) for x in masked.split("\n")] == [len(x) for x in text.split("\n")], path
    assert blank("a = 'it''s' # x", "python").strip() == "a ="
    assert blank('x "open\ny', "go") == "x      \ny"


def test_blocks_nest_and_open_ones_end_with_the_file():
    assert braced("a {\n b {\n } }\nc {\n}") == [(1, 1, 3, 0), (2, 2, 3, 1), (4, 4, 5, 0)]
    assert braced("}\nfor (;;) {\n x {\n") == [(2, 2, 4, 0), (3, 3, 4, 1)]
    assert indented("if a:\n  b\n  while c:\n\td\ne") == [(1, 1, 4, 0), (3, 3, 4, 1)]
    assert braced("") == indented("") == []


def test_search_in_scopes(spark):
    df = files_of(spark).unionByName(spark.createDataFrame([(None, None, "go", "func A() {\n\tB()\n}"), (None, None, "go", "func A() {\n\tC()\n}"), ("r", "x.go", "go", None), ("r", "y.txt", None, "func A() {}")], FILES))
    calls = {(r["file_path"], r["name"], r["start_line"], r["inside"]) for r in scope_search(df, "call", "^(go|call|run|no|get|B|C|yes)$").collect()}
    assert calls == {("a.rs", "go", 20, "run"), ("b.py", "call", 16, "inner"), ("c.js", "yes", 7, "K"), ("c.js", "no", 7, "K"), ("d.go", "run", 9, "Do"), ("E.java", "get", 17, "main"), (None, "B", 2, "A"), (None, "C", 2, "A")}
    methods = scope_search(df, "method", "^(Do|get)$").orderBy("file_path").collect()
    assert [(r["name"], r["start_line"], r["end_line"], r["inside"]) for r in methods] == [("get", 12, 15, "E"), ("Do", 7, 10, None)]
    assert methods[1]["snippet"] == "\n".join(CODE["d.go"][1].split("\n")[6:10])
    marked = with_scopes(df.withColumn("masked", df["content"])).filter("file_path = 'x.go' OR language IS NULL").collect()
    assert sorted((str(r["masked"]), len(r["scopes"])) for r in marked) == [("None", 0), ("func A() {}", 0)]
