import io
import zipfile

import pytest

from tesserae.operators import chunking as C
from tesserae.operators import tables
from tesserae.sources import code, delimited, formats, ingest, office, prose


def test_chunk_limits():
    long = " ".join(f"This is sentence number {i} of a long paragraph." for i in range(400))
    got = C.pack([{"kind": "paragraph", "text": long, "section_path": []}])
    assert len(got) > 5 and all(c["token_count"] <= C.MOST + 60 for c in got)
    rows = "\n".join(["| id | name |", "|---|---|", *(f"| {i} | name {i} |" for i in range(300))])
    parts = C.pack([{"kind": "table", "text": rows, "section_path": []}])
    assert len(parts) > 1 and all(p["text"].split("\n")[1] == "| id | name |" for p in parts)


def test_sections(spark):
    rows = [("d", 0, "heading", 1, "A"), ("d", 1, "paragraph", None, "x"), ("d", 2, "heading", 2, "B"), ("d", 3, "paragraph", None, "y"), ("d", 4, "heading", 1, "C"), ("d", 5, "list", None, "z")]
    df = spark.createDataFrame(rows, "doc_id string, seq long, kind string, heading_level int, text string")
    got = [r.section_path for r in C.sections(df).orderBy("seq").collect()]
    assert got == [["A"], ["A"], ["A", "B"], ["A", "B"], ["C"], ["C"]]


def test_symbols():
    text = "export function add(a, b) {\n  return a + b\n}\n\nclass Cart {\n  total() {}\n}"
    assert [s[0] for s in code.symbols(text, "typescript")[0]] == ["add", "Cart"]
    python = "import os\n\n@cached\ndef f():\n    pass\n\nclass A:\n    def g(self):\n        pass\n"
    assert code.symbols(python, "python") == ([("f", "function", 3, 5), ("A", "class", 7, 9)], "ast")
    assert code.uncovered(10, [(3, 5), (7, 9)]) == [(1, 2), (6, 6), (10, 10)]
    assert code.split_range(1, 250) == [(1, 120), (111, 230), (221, 250)]


def test_markdown_and_text():
    got = prose.parse_markdown("# T\n\npara\nmore\n\n- a\n- b\n\n```py\nx = 1\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> said\n")
    assert [e["kind"] for e in got] == ["heading", "paragraph", "list", "code", "table", "paragraph"]
    assert got[1]["line_start"] == 3 and got[1]["line_end"] == 4 and got[4]["table_rows"] == [["a", "b"], ["1", "2"]]
    assert [e["kind"] for e in prose.parse_text("TITLE\n\nSome prose here.\n\n- x\n- y")] == ["heading", "paragraph", "list"]
    assert prose.decode("é".encode()) == "é"


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


WORKBOOK = _zip({
    "xl/workbook.xml": '<w xmlns:r="u"><sheets><sheet name="S" r:id="r1"/><sheet name="H" state="hidden" r:id="r1"/></sheets></w>',
    "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>',
    "xl/sharedStrings.xml": "<sst><si><t>region</t></si><si><t>EU</t></si></sst>",
    "xl/worksheets/sheet1.xml": '<s><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row>'
    '<row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>5</v></c></row><row><c r="B3"><v>7</v></c></row>'
    '<mergeCells><mergeCell ref="A2:A3"/></mergeCells></s>',
})


def test_office():
    assert office.workbook_grids(WORKBOOK) == [("S", [["region", "n"], ["EU", "5"], ["EU", "7"]])]
    docx = _zip({"word/document.xml": '<d xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p>'
                 '<w:p><w:r><w:t>Text</w:t><w:br w:type="page"/></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></d>'})  # fmt: skip
    assert [(e["kind"], e["page"]) for e in office.parse_docx(docx)] == [("heading", 1), ("paragraph", 1), ("table", 2)]
    pptx = _zip({"ppt/slides/slide1.xml": '<p><sp><ph type="title"/><a><p><t>Hi</t></p></a></sp><sp><p><t>x</t></p><p><t>y</t></p></sp></p>',
                 "ppt/notesSlides/notesSlide1.xml": "<n><p><t>said</t></p></n>"})
    assert [e["kind"] for e in office.parse_pptx(pptx)] == ["heading", "list", "notes"]
    with pytest.raises(office.UnsafeContainer):
        office.check_container(b"plain")
    with pytest.raises(office.UnsafeContainer):
        office.check_container(_zip({"a": "0" * 5_000_000}))


def test_ingest(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nbody")
    (tmp_path / "b.py").write_text("def f():\n    return 1\n")
    (tmp_path / "c.xlsx").write_bytes(WORKBOOK)
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.bin").write_bytes(b"x")
    files = formats.scan(spark, str(tmp_path))
    parsed = ingest.parse(files)
    kinds = {(r.file_name, r.kind) for r in parsed.collect()}
    assert {("a.md", "heading"), ("a.md", "paragraph"), ("b.py", "code"), ("b.py", "symbol"), ("c.xlsx", "sheet_row"), ("d.pdf", "error")} <= kinds
    rows = tables.sheets_to_tables(ingest.sheet_rows(parsed))
    assert rows.count() == 2
    known = spark.createDataFrame([(r.doc_id, "k", "ready") for r in files.collect()], "doc_id string, index_key string, status string")
    assert ingest.fresh(files, known, "k").count() == 0 and ingest.fresh(files, known, "k2").count() == 4


def test_delimited(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("ticket;when;n\nT-1;2025-01-02;1,5\nT-2;2025-02-03;\n")
    t = delimited.read(spark, str(p))
    assert t.columns == ["ticket", "when", "n", "_is_total", "_row"] and [r._row for r in t.collect()] == [2, 3]


@pytest.mark.parametrize(
    "language, line, want",
    [
        ("go", "func (s *Store) Load(id int) error {", ("Load", "function")), ("go", "type Store struct {", ("Store", "type")),
        ("rust", "impl<T: Clone> Tree<T> {", ("Tree", "impl")), ("rust", "    pub async fn grow(&mut self) {", ("grow", "function")),
        ("java", "  public static int total(List<Integer> of) {", ("total", "function")), ("java", "  if (total(x)) {", None),
        ("java", "public final class Ledger {", ("Ledger", "class")), ("java", "  return total(x)", None),
        ("csharp", "internal sealed partial class Cart", ("Cart", "class")), ("c", "static int *find(char *name)", ("find", "function")),
        ("c", "int found = find(name);", None), ("cpp", "void Shop::Cart::add(int n) {", ("Shop::Cart::add", "function")),
        ("ruby", "  def self.empty?", ("self.empty?", "function")), ("kotlin", "data class Point(val x: Int)", ("Point", "class")),
        ("php", "  public function pay($sum) {", ("pay", "function")), ("javascript", "export const add = async (a, b) => a + b;", ("add", "function")),
        ("javascript", "while (more()) {", None), ("typescript", "export default interface Shape {", ("Shape", "interface")),
    ],
)
def test_lines_that_begin_symbols(language, line, want):
    assert code.declared(line, code.GRAMMARS[language]) == want


def test_long_classes_and_last_lines():
    body = "".join(f"    @cached\n    def m{i}(self):\n" + "        pass\n" * 60 for i in range(2))
    assert code.python_symbols("class Big:\n    x = 1\n" + body)[:2] == [("Big", "class", 1, 2), ("Big.m0", "method", 3, 64)]
    assert code.pattern_symbols("def a\n  1\nend\n\n\ndef b\nend\n\n", "ruby") == [("a", "function", 1, 3), ("b", "function", 6, 7)]
