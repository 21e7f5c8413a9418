from driftline.llm.generated import machine_files

FILES = {
    "a/x.pb.go": ([], "generated by name"), "vendor/q/z.go": ([], "vendored by place"), "x/vendors/list.py": (["# unlike the vendored copy, this list is kept by hand"], None), "web/app.min.js": ([], "minified by name"),
    "a/h.go": (["// Code generated by tool. DO NOT EDIT.", "x := 1"], "generated by header"), "a/codegen_h.go": (['if strings.Contains(s, "AUTOGENERATED") {', 'const banner = "@generated"', 'w.line("// Code generated by t. DO NOT EDIT.")'], None),
    "a/v.c": (["/*! lib v1.2.3 | bundled third-party library */"], "vendored by header"), "a/mock_q.go": (["// Mock of the q, written by hand."], None), "README.md": (["<!-- do not edit -->"], None),
    "a/t_data.py": (["{ 0x0e, 0x58, 0x34, 0xef }, # small", "    f.append(9)"], None), "a/bytes.go": (["var d = []byte{", ", ".join(f"0x{i:02x}" for i in range(60)) + ","], "data by layout"), "a/blob.ts": (['const d = "' + "aB3+/" * 60 + '"'], "data by layout"),
    "a/rows.py": (['{"a":"0x5241ccd2428882ce6d03ea1d399b82fc25db486956","b":"562225077757588495"},'] * 3, "data by layout"), "a/min.js": (["!function(i,p){e.g=i}(this,0);" * 20], "minified by layout"),
    "a/min.py": (["def f(x):return[i for i in x if i%2==0]and(lambda a:a+1)(x)"], None), "a/min.ts": (["e.f=function(a,b){return a*b}," * 9, "//# x"], "minified by layout"),
    "a/long.ts": (['throw new Error("' + "the peer did not answer in time " * 12 + '")'], None), "a/plain.go": (["x := a*b + c*3", None, "", "return nil, err"], None), "a/none.go": ([], None),
}


def test_reasons(spark):
    files = spark.createDataFrame([(1, f" ./{p}" if i % 2 else p, "r") for i, p in enumerate(FILES)] + [(1, None, "r"), (1, " ", "r"), (1, "a/x.pb.go", "r")], "side_id bigint, path string, reason string")
    lines = spark.createDataFrame([(1, p, t, 0) for p, (ts, _) in FILES.items() for t in ts], "side_id bigint, path string, text string, lines int")
    got = {r.path: r.reason for r in machine_files(files, lines, ["side_id"], "path", "text").collect()}
    assert got == {p: why for p, (_, why) in FILES.items() if why}
    assert machine_files(files.limit(0), lines.limit(0), ["side_id"], "path", "text").count() == 0
