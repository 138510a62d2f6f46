"""Source by a fixture whose declarations, calls and imports are worked out by hand."""

from tessera.operators import source as S

A = """import def, { one as uno, type Two, three } from './b.js';
import * as api from "../api";
import './side';
// function hidden() {}
/* class Hidden {} */
const text = "class Quoted { m() {} }" + `tpl ${call(`x${inner()}`)} function no() {}`;
const re = /function (\\/)[/]{/g, half = total / 2 / 3;

export interface Shape<T> extends Base {
  area(): number;
}

export abstract class Box<T> extends lib.Base<T> implements Shape<T>, Other {
  private size = measure(1);
  handler = () => { go(); };
  constructor(x: number) { super(x); setup(); }
  get width() { return this.size; }
  async open(a: { b: string } = {}): Promise<{ ok: boolean }> {
    await api.login(a);
    this.lid.lift?.();
    return new Thing(load()).run();
  }
  static close<K>(): void { }
  abstract later(): void;
}

export default async function main(args = defaults()) {
  const inner = function named() { helper(); };
  const o = { async method(x) { deep(x); }, plain: 1, other() { return 2; } };
  if (ready()) { uno(); }
  function nested() { arr[0].go(1); }
  return [1].map((x) => nested());
}
function over(a: string): void;
main();
export { over as again, main } from './c';
export * from './d';
const lazy = import('./lazy');
"""


def test_fixture(spark):
    files = spark.createDataFrame([("src/a.ts", A), ("src/empty.ts", ""), ("src/null.ts", None), ("src/odd.ts", "}}} class { ) ` ${ function")], "path string, text string")
    out = S.parsed(files)
    line = {i + 1: t for i, t in enumerate(A.split("\n"))}
    at = lambda part: next(i for i, t in line.items() if part in t)
    symbols = {(r.type, r.qualified): (r.start_line, r.end_line) for r in out["symbols"].where("path = 'src/a.ts'").collect()}
    assert symbols == {
        ("interface", "Shape"): (at("interface Shape"), at("interface Shape") + 2), ("class", "Box"): (at("abstract class"), at("abstract later") + 1), ("method", "Box.open"): (at("async open"), at("static close") - 1), ("method", "Box.later"): (at("abstract later"), at("abstract later")),
        ("function", "main"): (at("async function main"), at("function over") - 1), ("method", "method"): (at("async method"), at("async method")), ("method", "other"): (at("async method"), at("async method")), ("function", "nested"): (at("function nested"), at("function nested")),
        ("function", "over"): (at("function over"), at("function over")),
    }
    names = {r.id: r.qualified for r in out["symbols"].collect()}
    calls = {(r.name, r.qualifier, names.get(r.caller)) for r in out["calls"].where("path = 'src/a.ts'").collect()}
    assert calls == {
        ("call", None, None), ("inner", None, None), ("measure", None, None), ("go", None, None), ("setup", None, None), ("login", "api", "Box.open"), ("load", None, "Box.open"), ("run", "new Thing(load())", "Box.open"), ("defaults", None, "main"),
        ("helper", None, "main"), ("deep", None, "method"), ("ready", None, "main"), ("uno", None, "main"), ("go", "arr[0]", "nested"), ("map", "[1]", "main"), ("nested", None, "main"), ("main", None, None),
    }
    links = {(r.word, r.source): [tuple(b) for b in r.bindings] for r in out["links"].where("path = 'src/a.ts'").collect()}
    assert links == {
        ("import", "./b.js"): [("def", "default", "default"), ("uno", "one", "named"), ("Two", "Two", "named"), ("three", "three", "named")], ("import", "../api"): [("api", "*", "namespace")], ("import", "./side"): [],
        ("export", "./c"): [("again", "over", "named"), ("main", "main", "named")], ("export", "./d"): [("*", "*", "all")],
    }
    assert {(names[r.id], r.parent, r.kind) for r in out["heritage"].collect()} == {("Box", "Base", "INHERITS"), ("Box", "Shape", "IMPLEMENTS"), ("Box", "Other", "IMPLEMENTS")}
    assert out["symbols"].where("path IN ('src/empty.ts', 'src/null.ts')").count() == 0 and S.parsed(files.limit(0))["calls"].count() == 0
