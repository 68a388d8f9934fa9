import random

import pyarrow as pa

from weft.operators import rejects

P = "initial_snapshot/dynamic/Person/part-0.csv"
DDL = "file_name string, line_no bigint, line string, entity int, reason int"


def judged(spark, lines, name=P):
    rows = [(name, i + 1, s, 0, 0) for i, s in enumerate(lines)]
    out = rejects.parse_snapshot(spark.createDataFrame(rows, DDL)).collect()
    return {r["line_no"]: r["reason"] for r in out}, {r["line_no"]: r for r in out}


def test_reasons(spark):
    ok = "7|1600000000000|Ann|Lee"
    lines = [
        "id|creationDate|firstName|lastName", ok, "﻿" + ok + "\r", "", None, "   ",
        '8|1600000000000|"open|Lee', ok, '9|1600000000000|"a"b|Lee', '9|1600000000000|a"b|Lee', '10|1600000000000|"a|b"|"q""q"',
        "11|1600000000000|Ann", "12|1600000000000|Ann|Lee||", "+13|1600000000000|Ann|Lee", "9223372036854775808|1600000000000|A|L", "0009223372036854775807|946684800000|A|L",
        "14|4102444800000|A|L", "15|946684799999|A|L", '"16"|"1600000000000"|A|L', "17 |1600000000000|A|L", "１|1600000000000|A|L", "|1600000000000|A|L", '18|"1600000000000|A|L"', 'x|"y',
    ]
    reasons, rows = judged(spark, lines)
    want = {2: None, 3: None, 7: "quoting", 8: None, 9: "quoting", 10: "quoting", 11: None, 12: "columns", 13: "columns", 14: "value", 15: "value", 16: None, 17: "value", 18: "value", 19: None, 20: "value", 21: "value", 22: "value", 23: "columns", 24: "quoting"}
    assert reasons == want
    assert rows[11]["props"] == {"firstName": "a|b", "lastName": 'q"q'} and rows[16]["id"] == 2**63 - 1


def test_many_open_quotes_lose_no_line(spark):
    rng = random.Random(1)
    lines, want = [], {}
    for i in range(3000):
        kind = rng.randrange(6)
        s, r = [("{}|1600000000000|A|L", None), ('{}|1600000000000|"A|L', "quoting"), ('{}|1600000000000|A"|"L', "quoting"), ('{}|1600000000000|"A"|"L"', None), ("{}|1600000000000|A", "columns"), ('"{}|1600000000000|""|L', "quoting")][kind]
        lines.append(s.format(i))
        want[i + 1] = r
    assert judged(spark, lines)[0] == want


def test_edges_of_input(spark):
    assert judged(spark, [])[0] == {}
    long = "1|1600000000000|" + "x" * 3_000_000 + "|L"
    assert judged(spark, [long, "a\nb|1|c|d", "2|1600000000000|a\rb|L"])[0] == {1: None, 2: "value", 3: None}
    assert judged(spark, ["1|2"], "odd.csv")[0] == {1: "entity"}
    parsed = rejects.parse_snapshot(spark.createDataFrame([(P, 1, "x|1|a|b", 0, 0)] * 2, DDL))
    assert rejects.bad_lines(parsed).count() == 1
    posts = rejects.parse_snapshot(spark.createDataFrame([("a/b/Post/x", 1, "5|1600000000000|hi|3", 0, 0)], DDL))
    row = rejects.vertices(posts).first()
    assert row["labels"] == ["Post", "Message"] and row["props"] == {"content": "hi", "personId": "3", "creationDate": "1600000000000"}


def by_hand(line, names):
    """The reason of a line, field by field and character by character."""
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i += 1
            value = ""
            while True:
                if i >= len(line):
                    return "quoting"
                if line[i] == '"' and line[i + 1 : i + 2] == '"':
                    value, i = value + '"', i + 2
                elif line[i] == '"':
                    i += 1
                    break
                else:
                    value, i = value + line[i], i + 1
            if i < len(line) and line[i] != "|":
                return "quoting"
        else:
            j = line.find("|", i)
            j = len(line) if j < 0 else j
            value, i = line[i:j], j
            if '"' in value:
                return "quoting"
        fields.append(value)
        if i >= len(line):
            break
        i += 1
    if len(fields) != len(names):
        return "columns"
    vid, date = fields[names.index("id")], fields[names.index("creationDate")]
    good = vid.isascii() and vid.isdigit() and int(vid) <= rejects.MAX_ID and date.isascii() and date.isdigit() and rejects.MIN_DATE <= int(date) < rejects.END_DATE
    return None if good else "value"


def test_order_and_batches_do_not_matter():
    rng = random.Random(6)
    pieces = ['"', '""', "|", "a", "|", '"A"', "7", "|1600000000000|", "|", '""""']
    lines = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    lines += [f'{i}|1600000000000|{rng.choice(["A", chr(34) * 2, chr(34) + "A" + chr(34)])}|L' for i in range(3000)] + [f'{i}|1600000000000|"A|L' for i in range(60)]
    names = rejects.ENTITY_COLUMNS["Person"]
    for size in (7, 700, len(lines)):
        rng.shuffle(lines)
        batches = [pa.RecordBatch.from_pydict({"file_name": [P] * len(part), "line_no": list(range(k, k + len(part))), "line": part}) for k in range(0, len(lines), size) if (part := lines[k : k + size])]
        got = {}
        for out in rejects.parse_batches(iter(batches)):
            for k, reason in zip(out.column("line_no").to_pylist(), out.column("reason").to_pylist(), strict=True):
                assert k not in got
                got[k] = reason
        assert got == {k: by_hand(s, names) for k, s in enumerate(lines) if s.strip()}


def test_an_open_quote_at_the_head_condemns_itself_only(spark):
    assert judged(spark, ['1|1600000000000|"A|L', "2|1600000000000|B|L"])[0] == {1: "quoting", 2: None}
