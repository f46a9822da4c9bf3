import io
import json
import os
import shutil
import subprocess
import zipfile

import pytest

from linkora import cli
from linkora.plans import check as plans
from linkora.sources import config, jars, jdk

OLD = {"lib/A.java": "package lib; public class A { public void gone() {} public void stays() {} public static void s() {} }", "lib/B.java": "package lib; public class B {}", "lib/I.java": "package lib; public interface I { void run(); }", "lib/P.java": "package lib; public class P { public void fin() {} }"}
NEW = {"lib/A.java": "package lib; public class A { public void stays() {} public void s() {} }", "lib/B.java": "package lib; public final class B {}", "lib/I.java": "package lib; public interface I { void run(); void more(); }", "lib/P.java": "package lib; public class P { public final void fin() {} }"}
APP = {"app/Use.java": "package app; public class Use { void f(lib.I i) { new lib.A().gone(); new lib.A().stays(); lib.A.s(); i.run(); } }", "app/Sub.java": "package app; public class Sub extends lib.B {}", "app/Impl.java": "package app; public class Impl implements lib.I { public void run() {} }", "app/Over.java": "package app; public class Over extends lib.P { public void fin() {} }"}


@pytest.fixture(scope="module")
def trees(tmp_path_factory):
    if not shutil.which("javac"):
        pytest.skip("no javac")
    top, out = tmp_path_factory.mktemp("upgrade"), {}
    for name, files in (("old", OLD), ("new", NEW), ("app", APP)):
        for f, text in files.items():
            path = top / f"{name}-src" / f
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
        subprocess.run(["javac", "-cp", str(top / "old"), "-d", str(top / name), *[str(top / f"{name}-src" / f) for f in files]], check=True, timeout=120)
        out[name] = str(top / name)
    return out


def test_check_from_paths(spark, trees, tmp_path):
    rules = tmp_path / "rules.toml"
    rules.write_text('[[exclude]]\nowner = "lib.B"\nreason = "known"\n[[exclude]]\nowner = "no.Such"\nreason = "stale"\n')
    args = ["check", "--old", trees["old"], "--new", trees["new"], "--classpath", trees["app"], "--app", trees["app"], "--exclude-file", str(rules), "--json"]
    out = io.StringIO()
    assert cli.run(spark, args, out) == 1
    got = json.loads(out.getvalue())
    found = {(v["source_class"], v["owner"], v.get("name"), v["reason"]) for v in got["violations"]}
    # The rule hides that app/Sub extends a class that became final.
    assert found == {
        ("app/Use", "lib/A", "gone", "method removed"),
        ("app/Use", "lib/A", "s", "method became instance"),
        ("app/Impl", "lib/I", "more", "method became abstract"),
        ("app/Over", "lib/P", "fin", "method became final"),
    }
    assert got["scanned_classes"] == 4 and got["total"] == 4 and got["suppressed"] == 1
    assert all(v["reachable"] for v in got["violations"])
    assert {v["tier"] for v in got["violations"] if v["source_class"] == "app/Impl"} == {"latent"}


def test_diff_from_paths(spark, trees):
    out = io.StringIO()
    assert cli.run(spark, ["diff", trees["old"], trees["new"], "--json"], out) == 0
    got = json.loads(out.getvalue())
    kinds = {(c["kind"], c["class_name"], c.get("name")) for c in got["breaking_changes"]}
    assert {("method_removed", "lib/A", "gone"), ("method_became_instance", "lib/A", "s"), ("class_became_final", "lib/B", None), ("method_became_final", "lib/P", "fin")} == kinds and got["total"] == 4


def jar(folder, path):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, files in os.walk(folder):
            for f in sorted(files):
                full = os.path.join(top, f)
                z.write(full, os.path.relpath(full, folder))
    return str(path)


def test_upgrade_check_by_module(spark, trees, tmp_path):
    old, new = jar(trees["old"], tmp_path / "lib-1.jar"), jar(trees["new"], tmp_path / "lib-2.jar")
    (tmp_path / "broken.jar").write_bytes(b"no archive")
    lib = lambda v, f: ("g", "lib", v, f, None)
    broken = ("h", "broken", "1", str(tmp_path / "broken.jar"), None)
    app = trees["app"]
    before, after = str(tmp_path / "before.json"), str(tmp_path / "after.json")
    # a and b share a run, same did not move, lost has no artifacts left, fresh is new, renamed had the library under another name.
    jars.write_dump(before, [(m, app) for m in ("a", "b", "same", "lost", "was")], [(m, *lib("1", old)) for m in ("a", "b", "lost", "was")] + [("same", *broken)])
    jars.write_dump(after, [(m, app) for m in ("a", "b", "same", "lost", "fresh")] + [("renamed", app)], [(m, *x) for m in ("a", "b") for x in (lib("2", new), broken)] + [("same", *broken), ("renamed", *lib("2", new))])
    assert jars.load_dump(after)["artifacts"][0] == ("a", *lib("2", new))
    log = tmp_path / "load.log"
    log.write_text("[class,load] app.Sub source: x\n")
    draft = tmp_path / "draft.toml"
    out = io.StringIO()
    args = ["upgrade-check", "--before", before, "--after", after, "--json", "--class-load-log", str(log), "--draft-exclude-file", str(draft), "--verdicts-json", str(tmp_path / "verdicts")]
    assert cli.run(spark, args, out) == 1
    got = json.loads(out.getvalue())
    assert got["changes"] == [{"coordinate": "g:lib", "kind": "changed", "before": ["1"], "after": ["2"]}]
    runs = got["module_runs"]
    assert [o["modules"] for o in runs["outcomes"]] == [["a", "b"], ["renamed"]] and {o["broken"] for o in runs["outcomes"]} == {5}
    assert (runs["total_modules"], runs["unchanged_modules"], runs["new_modules"], runs["incomplete_modules"]) == (6, 1, 1, 1)
    rows = {(v["source_class"], v["reason"]): v for v in got["violations"]}
    assert len(rows) == len(got["violations"]) == 5
    gone = rows["app/Use", "method removed"]
    assert gone["modules"] == ["a", "b", "renamed"] and gone["suggestion"]["removed_by"] == "g:lib" and "g:lib at 1" in gone["suggestion"]["advice"]
    assert rows["app/Sub", "class became final"]["observed_loading"] and not gone["observed_loading"]
    verdicts = spark.read.json(str(tmp_path / "verdicts"))
    assert {r.module for r in verdicts.select("module").distinct().collect()} == {"a,b", "renamed"}
    assert "No rule" in draft.read_text()
    text = io.StringIO()
    cli.run(spark, ["upgrade-check", "--before", before, "--after", after, "--merged", "--fail-on", "never"], text)
    assert "changed g:lib 1 -> 2" in text.getvalue() and "broken.jar" in text.getvalue() and "advice: " in text.getvalue()


def test_services_and_shadowed_copies(spark, tmp_path):
    files = {"lib/S.java": "package lib; public interface S {}", "lib/Good.java": "package lib; public class Good implements S {}", "lib/Bad.java": "package lib; public class Bad implements S { %s }"}
    for side, ctor in (("old", "public Bad() {}"), ("new", "private Bad() {}")):
        top = tmp_path / f"{side}-src"
        top.mkdir()
        for f, text in files.items():
            (top / f.split("/")[-1]).write_text(text % ctor if "%s" in text else text)
        subprocess.run(["javac", "-d", str(tmp_path / side), *map(str, top.glob("*.java"))], check=True, timeout=120)
        listed = tmp_path / side / "META-INF" / "services"
        listed.mkdir(parents=True)
        (listed / "lib.S").write_text("# all\nlib.Good\nlib.Bad # broken\n")
    old, new = jar(tmp_path / "old", tmp_path / "a.jar"), jar(tmp_path / "new", tmp_path / "b.jar")
    twin = jar(tmp_path / "new", tmp_path / "c.jar")
    found = plans.check(spark, [old], [new], [new, twin])
    assert {(r.source_class, r.owner, r.reason, r.source) for r in found.violations.collect()} == {("lib/Bad", "lib/S", "service provider not instantiable", new)}
    # The second copies are counted, not read.
    assert found.scanned_classes == 6 and plans.load(spark, [new, twin]).scanned.count() == 3


def test_platform_layer_and_names(spark, trees):
    home = os.path.dirname(os.path.dirname(os.path.realpath(shutil.which("javac"))))
    if not os.path.exists(f"{home}/lib/ct.sym"):
        pytest.skip("no release stubs")
    os.environ["LINKORA_JDK"] = home
    try:
        assert jdk.stubs(11).endswith("ct.sym") and 11 in jdk.releases(jdk.stubs(11)) and jdk.installed_release(home) not in jdk.releases(jdk.stubs(11))
        roots = spark.createDataFrame([("java/util/ArrayList",), ("no/Such",)], "class_name string")
        got = {r.class_name for r in jars.release_closure(spark, jdk.stubs(11), 11, roots).collect()}
        assert {"java/util/ArrayList", "java/util/AbstractList", "java/util/Collection", "java/lang/Iterable", "java/io/Serializable"} <= got and len(got) < 20
        plain = plans.check(spark, [trees["old"]], [trees["new"]], [trees["app"]], release=11)
        assert plain.violations.count() == 5
        with pytest.raises(ValueError):
            jdk.stubs(jdk.installed_release(home))
    finally:
        del os.environ["LINKORA_JDK"]
    with pytest.raises(ValueError):
        cli.validated(cli.parser().parse_args(["check", "--jdk-release-old", "11"]))
    with pytest.raises(ValueError):
        cli.validated(cli.parser().parse_args(["check", "--old", "a"]))
    with pytest.raises(ValueError):
        cli.validated(cli.parser().parse_args(["check", "--old", "a", "--new", "b", "--draft-exclude-file", "x"]))


def test_wanted_and_optional(spark, tmp_path):
    pom = "<project><dependencies><dependency><groupId>g</groupId><artifactId>n</artifactId><optional>true</optional></dependency></dependencies></project>"
    place = tmp_path / "a" / "1" / "abc"
    (tmp_path / "a" / "1" / "def").mkdir(parents=True)
    place.mkdir()
    (tmp_path / "a" / "1" / "def" / "a-1.pom").write_text(pom)
    assert config.read_optional(str(place / "a-1.jar"), "x:a:1") == {("g", "n")} and config.read_optional("a-1.jar", "x:a:1") == set()
    assert jars.stub_entry("89A/java.base/java/lang/X.sig") == ("89A", "java/lang/X") and jars.stub_entry("9-modules/x.sig") is None and jars.stub_entry("8/java/lang/X.sig") == ("8", "java/lang/X")
