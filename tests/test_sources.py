import json
import shutil
import subprocess
import zipfile

import pytest

from linkora.sources import classfile, config, jars

JAVA = {
    "lib/Base.java": "package lib; public class Base { public static int n; public void run() {} public Base() {} }",
    "lib/Shape.java": "package lib; public sealed interface Shape permits Dot {}",
    "lib/Dot.java": "package lib; public final class Dot implements Shape {}",
    "app/Main.java": 'package app; public class Main extends lib.Base { void go(int k) throws Exception { n = 3; run(); new lib.Dot(); Class.forName("lib.Dot"); switch (k) { case 1: n = 1; case 2: n = 2; case 900000: n = 4; } } }',
}


@pytest.fixture(scope="module")
def jar(tmp_path_factory):
    if not shutil.which("javac"):
        pytest.skip("no javac")
    top = tmp_path_factory.mktemp("java")
    for name, text in JAVA.items():
        (top / name).parent.mkdir(exist_ok=True)
        (top / name).write_text(text)
    subprocess.run(["javac", "-d", str(top / "out"), *[str(top / n) for n in JAVA]], check=True, timeout=120)
    path = top / "a.jar"
    with zipfile.ZipFile(path, "w") as z:
        for f in (top / "out").rglob("*.class"):
            z.write(f, f.relative_to(top / "out").as_posix())
        z.writestr("META-INF/services/lib.Shape", "lib.Dot # the one\n\r# none\n")
        z.writestr("bad/NoMagic.class", b"no")
    return str(path)


def test_parse_of_compiled_classes(jar):
    with zipfile.ZipFile(jar) as z:
        main, shape = classfile.parse(z.read("app/Main.class")), classfile.parse(z.read("lib/Shape.class"))
    assert main["super_name"] == "lib/Base" and shape["permitted"] == ["lib/Dot"]
    refs = [(r["kind"], r["owner"], r["name"], r["expected_static"], r["field_write"], r["instantiated"]) for r in main["refs"]]
    assert refs.count(("field", "app/Main", "n", True, True, None)) == 4
    assert ("method", "app/Main", "run", False, None, None) in refs
    assert ("class", "lib/Dot", None, None, None, True) in refs
    assert {"lib/Base", "lib/Dot", "java/lang/Class"} <= set(main["loads"])


def test_broken_classes():
    for data in (b"", b"\xca\xfe\xba\xbe", b"\xca\xfe\xba\xbe" + b"\0\0\0\x37\0\x02\x63"):
        with pytest.raises(classfile.ClassFormatError):
            classfile.parse(data)
    assert classfile.modified_utf8(b"a\xc0\x80b") == "a\0b"
    assert classfile.modified_utf8(b"\xed\xa0\xbd\xed\xb8\x80") == "\U0001f600"


def test_jar_to_frames(spark, jar):
    found = jars.entries(spark, [jar])
    classes = jars.parsed(found).persist()
    assert {r.class_name for r in jars.class_api(classes).collect()} == {"lib/Base", "lib/Shape", "lib/Dot", "app/Main"}
    assert [tuple(r) for r in jars.services(found).select("iface", "provider").collect()] == [("lib/Shape", "lib/Dot")]
    assert jars.symbol_refs(classes).where("owner = 'lib/Dot' and instantiated").count() == 1
    assert jars.load_edges(classes).where("src = 'app/Main' and dst = 'lib/Dot'").count() == 1
    assert jars.entries(spark, []).count() == 0


def test_dumps(tmp_path):
    one = {"modules": [{"module": "m", "classesDirs": ["c"], "artifacts": [{"group": "g", "name": "n", "version": "1", "file": "/r/n.jar"}]}], "jdkRelease": 17}
    two = {"version": 2, "roots": ["/r/"], "jdkRelease": 17, "artifacts": [{"group": "g", "name": "n", "version": "1", "root": 0, "path": "n.jar"}], "modules": [{"module": "m", "classesDirs": [], "artifactRefs": [0]}]}
    for i, d in enumerate((one, two)):
        (tmp_path / f"{i}.json").write_text(json.dumps(d))
    a, b = (jars.load_dump(str(tmp_path / f"{i}.json")) for i in (0, 1))
    assert a["artifacts"] == b["artifacts"] == [("m", "g", "n", "1", "/r/n.jar", None)]
    two["modules"][0]["artifactRefs"] = [7]
    (tmp_path / "2.json").write_text(json.dumps(two))
    with pytest.raises(ValueError):
        jars.load_dump(str(tmp_path / "2.json"))


def test_rules_and_poms():
    assert config.exclude_rules('[[exclude]]\nowner = "a.b.*"\nreason = "x"') == [(0, "a/b/*", None, None, None, "x")]
    for bad in ('owner = "a"', 'owner = "a"\nreason = " "', 'member = "m"\nkind = "k"\nreason = "x"', 'owner = "a*b*"\nreason = "x"', 'owner = "a"\nreason = "x"\nmore = 1'):
        with pytest.raises(ValueError):
            config.exclude_rules("[[exclude]]\n" + bad)
    dep = "<dependency><groupId>g</groupId><artifactId>{}</artifactId>{}</dependency>"
    pom = "<project>" + dep.format("a", "<optional>true</optional>") + dep.format("b", "") + "<!--" + dep.format("c", "<optional>true</optional>") + "--><profiles>" + dep.format("b", "<optional>true</optional>") + "</profiles></project>"
    assert config.optional_dependencies(pom) == {("g", "a")}
