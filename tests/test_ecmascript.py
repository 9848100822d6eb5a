from codelode.operators import ecmascript_analysis as js

CODE = '''// the api
import React, { useState as use, type Props } from "react";
import * as util from './util';
import './style.css';
export { helper as aid } from "./helper";
export * from './all';
const fs = require("fs");

/** Loads things. */
export async function load(a: string, b = ")"): Promise<void> {
  const r = await fetch(`/api/items/${a}`);
  return util.parse(r, /[)}]/g);
}

export const Card = ({ title }: Props) => {
  const [x] = use(0);
  return <Panel title={title}><b>{x}</b></Panel>;
};

class Service extends Base implements Thing {
  static count = 0;
  constructor(private a: number) { super(); }
  async run(q) { if (q) { this.stop(); } return new Job(q); }
  stop = () => { api.post("/stop"); };
}

interface Thing extends Other { a: string }
export type Id = string | number;
enum Color { Red }
export default Service;
'''


def test_symbols():
    got = js.analyze(CODE)
    by = {s["qualified_name"]: s for s in got["symbols"]}
    kinds = {k: v["kind"] for k, v in by.items()}
    assert kinds == {"load": "function", "Card": "component", "Service": "class", "Service.constructor": "method", "Service.run": "method", "Service.stop": "method", "Thing": "interface", "Id": "type_alias", "Color": "enum"}
    assert got["status"] == "parsed" and got["has_jsx"]
    assert by["load"]["docstring"] == "Loads things." and by["load"]["is_async"] and by["load"]["parameters"] == ["a: string", 'b = ")"'] and by["load"]["return_type"] == "Promise<void>"
    assert (by["load"]["start_line"], by["load"]["end_line"]) == (10, 13)
    assert by["Service"]["bases"] == ["Base", "Thing"] and by["Service"]["is_exported"] and not by["Thing"]["is_exported"]


def test_imports_exports_calls():
    got = js.analyze(CODE)
    assert {(i["module"], i["kind"]) for i in got["imports"]} == {("react", "import"), ("./util", "import"), ("./style.css", "side_effect"), ("./helper", "re_export"), ("./all", "re_export"), ("fs", "require")}
    react = next(i for i in got["imports"] if i["module"] == "react")
    assert react["names"] == [{"name": "default", "alias": "React"}, {"name": "useState", "alias": "use"}, {"name": "Props", "alias": None}]
    assert {(e["name"], e["kind"]) for e in got["exports"]} >= {("aid", "re_export"), ("*", "namespace"), ("Service", "default"), ("load", "named"), ("Card", "named"), ("Id", "named")}
    calls = {(c["callee"], c["caller"], c["kind"]) for c in got["calls"]}
    assert {("util.parse", "load", "call"), ("Job", "Service.run", "new"), ("this.stop", "Service.run", "call"), ("api.post", "Service.stop", "call")} <= calls
    assert [(r["component"], r["caller"]) for r in got["renders"]] == [("Panel", "Card")]
    assert {(a["client"], a["method"], a["url"]) for a in got["api_calls"]} == {("fetch", "GET", "/api/items/{a}"), ("api", "POST", "/stop")}


def test_broken_and_empty(spark):
    assert js.analyze("function a() { if (x { }")["status"] == "partial"
    rows = spark.createDataFrame([("r", "a.ts", None), ("r", "b.ts", "export function f() {}"), ("r", "c.js", "`${`")], "repository_id string, path string, content string")
    got = {r["path"]: r for r in js.analyze_ecmascript(rows).collect()}
    assert got["a.ts"]["symbols"] == [] and got["b.ts"]["symbols"][0]["name"] == "f" and len(got) == 3
