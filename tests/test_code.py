"""Source code with traps: strings, comments and imports that resolve to files."""

from quillion.sources import connectors

FILES = [
    ("pkg/a.py", 'r"""\nimport trap\ndef no(): pass\n"""\nimport pkg.b, os\nfrom c import d\n# def no(): \'\nx = "# \\" def no"; y = \'"\'\nclass K:\n    def m(self):\n        s = \'\'\'\nclass No:\n\'\'\'\n'),
    ("pkg/b.py", "import os"), ("lib/c.py", ""), ("pkg/c.py", ""),
    ("web/x.ts", "import a from './util/y'\nimport b from \"../web/z.js\"\nconst s = \"import q from 'no'\"; const t = `function no() {}\nimport r from 'no2'`\n// function no() {}\n/* class No {} */\nexport function go() { return '//' }\nconst l = require('left-pad')\n"),
    ("web/util/y.ts", "export class Y {}"), ("web/z.js", "function z() { /* ' */ }\nfunction zz() {}"),
    ("J.java", 'import java.util.List;\nimport app.K;\nclass J { String s = "\\"; import no.No;"; char c = \'"\'; /* enum No {} */ }\n// interface No {}\n'), ("src/app/K.java", "public final class K {}"),
    ("m.go", 'package m\nimport (\n\t"fmt"\n\tq "x/y"\n)\n// func No() {}\nvar s = `\nfunc No() {}\n"no"\n`\nfunc Run() { print("func No") }\n'),
    ("r.rs", 'use std::io;\n/* fn no() {} /* nested */ fn no2() {} */\nfn main() { let c = \'"\'; let s = "fn no3()"; }\n// fn no4()\nstruct S<\'a>(&\'a str);\n'),
    ("x.txt", "def no(): pass"),
]


def test_traps_and_resolved_imports(spark):
    nodes, edges = connectors.code_graph(spark.createDataFrame([*FILES, ("none.py", None)], "path string, content string"))
    got = sorted((r.source_node_id, r.target_node_id, r.relation) for r in edges.collect())
    defines = {"pkg/a.py": ["K", "m"], "web/x.ts": ["go"], "web/util/y.ts": ["Y"], "web/z.js": ["z", "zz"], "J.java": ["J"], "src/app/K.java": ["K"], "m.go": ["Run"], "r.rs": ["S", "main"]}
    imports = {"pkg/a.py": ["pkg/b.py", "lib/c.py"], "pkg/b.py": ["os"], "web/x.ts": ["web/util/y.ts", "web/z.js", "left-pad"], "J.java": ["java.util.List", "src/app/K.java"], "m.go": ["fmt"], "r.rs": ["std::io"]}
    want = [(f, f"{f}#{n}", "defines") for f, names in defines.items() for n in names] + [(f, n, "imports") for f, names in imports.items() for n in names]
    assert got == sorted(want)
    assert nodes.where("node_type = 'file'").count() == len(FILES) + 1


def test_tasks_that_read_files_hold_no_rows(spark, tmp_path):
    """Up to the first exchange above a scan nothing is sorted or grouped, lists aren't found twice for a filter by their size, and no side passes the driver."""
    files = [(f"p{i:02}/util.py", "import util\nimport p01.util\ndef f(): pass\n") for i in range(40)]
    spark.createDataFrame(files, "path string, content string").write.parquet(str(tmp_path / "files"))
    edges = connectors.code_graph(spark.read.parquet(str(tmp_path / "files")))[1]
    plan, above, scans = edges._jdf.queryExecution().executedPlan().toString(), [], 0
    for line in plan.splitlines():
        node = line.lstrip(" :+-")
        depth = len(line) - len(node)
        above = [x for x in above if x[0] < depth] + [(depth, node)]
        if node.startswith("FileScan"):
            scans += 1
            names = [x[1] for x in reversed(above)]
            sent = next((i for i, x in enumerate(names) if x.startswith("Exchange")), len(names))
            assert not [x for x in names[:sent] if x.startswith(("Sort", "HashAggregate", "ObjectHashAggregate", "Filter (size", "Filter ((size"))]
    assert scans and "Broadcast" not in plan
    got = sorted((r.source_node_id, r.target_node_id, r.relation) for r in edges.collect())
    want = [(f, f"{f}#f", "defines") for f, _ in files] + [(f, t, "imports") for f, _ in files for t in ("p00/util.py", "p01/util.py")]
    assert got == sorted(want)


def test_imports_of_one_file_are_one_edge(spark):
    files = [("a.py", "import lib.b\nimport b\nimport b"), ("lib/b.py", ""), ("lib/c.py", "from b import x")]
    edges = connectors.code_graph(spark.createDataFrame(files, "path string, content string"))[1]
    assert sorted(r.source_node_id + " " + r.target_node_id for r in edges.collect()) == ["a.py lib/b.py", "lib/c.py lib/b.py"]
