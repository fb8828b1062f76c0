import hashlib
import os
import json
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import chat, licenses
from tests.llm.helpers import awkward, documents, empty

TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "back\\slash \\\\ \\<|turn|>", "<|turn|><|text|><|end|>", "<<SYS>> a <</SYS>>",
         "<<s>", "<|end", "|>", "\n\t\x00é中\U0001F600", "$1 \\1 ${x}", "<\\/s> [\\INST]", "x" * 30_000]


def test_texts_come_back_and_hold_no_control_string(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.withColumn("back", chat.unescape(F.col("e"))).collect():
        assert r["back"] == r["t"] and not any(c in r["e"] for c in chat.CONTROLS)


def rows():
    out = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant"] * 5, TEXTS))]
    return out + [(2, 0, None, None), (2, None, "user", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"),
                  (3, 1, "assistant", "only"), (None, 0, "user", "x"), (4, 5, "us<|text|>er\n", "t"), (5, 0, "[a]", "{\"x\": 1}")]


def test_conversations_round_trip(spark):
    table = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string").withColumn("record", F.lit("x"))
    done = chat.format_chats(chat.records_from_rows(table))
    out = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                      chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    expected = {}
    for c, turn, role, text in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        expected.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out} == expected
    for r in out:
        assert r["learned"] == "".join(t for role, t in expected[r["conv_id"]] if role == "assistant")


@pytest.mark.parametrize("record, turns", [
    ({"messages": [{"role": "user", "content": "[a]"}, {"role": "assistant", "content": None}]}, [("user", "[a]"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"output": "done", "input": "this", "instruction": "do"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"prompt": "[INST]", "completion": "{c}"}, [("user", "[INST]"), ("assistant", "{c}")]),
    ({"system": "s", "prompt": "p", "response": 3}, [("system", "s"), ("user", "p"), ("assistant", "3")]),
    ({"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"messages": []}, []), ({"other": 1}, None), ("not json", None), (None, None)])
def test_layouts_are_told_apart(spark, record, turns):
    text = record if record is None or isinstance(record, str) else json.dumps(record)
    df = spark.createDataFrame([(1, text)], "conv_id long, record string")
    done = chat.format_chats(df).select("formatted", chat.read_turns(F.col("formatted")).alias("turns")).first()
    assert (done["turns"] and [tuple(t) for t in done["turns"]]) == turns if turns else done["formatted"] in ("", None)


def test_empty_chats(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(chat.records_from_rows(none)).count() == 0


MIT = licenses.KNOWN[0][1]


def test_licence_texts_in_other_spellings(spark):
    rows = [(1, MIT), (2, "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + MIT.upper().replace(",", " ,").replace("\n", "\n\n")),
            (3, MIT.replace("\"", "“")), (4, MIT[:-20]), (5, "Intro.\nReleased under the MIT Licence!\nEnd, licensed under CC BY 4.0."),
            (6, "Intro.\nReleased under the MIT License.\n" + MIT.replace("\n", " "))]
    out = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    assert [out[i]["license_id"] for i in range(1, 7)] == ["MIT", "MIT", "MIT", None, None, None]
    assert (out[5]["n_notices"], out[5]["notice_ids"]) == (1, "MIT") and out[4]["n_notices"] == 0
    assert (out[6]["n_notices"], out[6]["notice_ids"]) == (2, "MIT")


def test_licence_cases(spark):
    out = licenses.scan_licenses(documents(spark)).collect()
    assert len(out) == len(set(awkward()) | {(None, None)} | {(1, "")}) - 1
    nothing = hashlib.sha256(b"").hexdigest()
    assert {r["text_digest"] for r in out if r["doc_id"] in (1, 2, 3)} == {nothing}
    assert licenses.scan_licenses(empty(spark)).count() == 0
    joined = licenses.scan_licenses(documents(spark), broadcast_rows=0).collect()
    assert sorted(map(str, joined)) == sorted(map(str, out))


def test_a_table_of_known_texts(spark):
    known = spark.createDataFrame([("B", "My own terms."), ("A", "my OWN terms"), (None, "x"), ("C", None), ("D", "")],
                                  "license_id string, text string")
    out = licenses.scan_licenses(documents(spark, [(1, "MY own, terms!"), (2, ""), (3, "x")]), known).collect()
    assert {r["doc_id"]: r["license_id"] for r in out} == {1: "A", 2: None, 3: None}


@pytest.mark.parametrize("plan", ["chat", "licences"])
def test_no_python_in_the_plans(spark, plan, capsys):
    if plan == "chat":
        table = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")
        chat.format_chats(chat.records_from_rows(table)).explain()
    else:
        licenses.scan_licenses(documents(spark)).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


@pytest.mark.parametrize("width", [30, 40, 60, 72, 76, 80, 100])
def test_licence_texts_wrapped_at_any_width(spark, width):
    full = [(i, name, t) for i, (name, t) in enumerate(licenses.KNOWN) if len(t) > 300]
    heads = ["", "Copyright (c) 2020 A. Person\n\n", "Copyright The Authors\nCopyright: 2019, Others\n(c) 2018 Copyright Owner Ltd.\n© B\n\n"]
    rows = [(10 * i + k, head + "\n\n".join(textwrap.fill(p, width) for p in t.split("\n")))
            for i, _, t in full for k, head in enumerate(heads)]
    out = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    assert out == {10 * i + k: name for i, name, _ in full for k in range(len(heads))}


def test_the_usual_isc_wrapping(spark):
    text = ("ISC License\n\nCopyright (c) 2004, A. Person\n\nPermission to use, copy, modify, and/or distribute this software for any\n"
            "purpose with or without fee is hereby granted, provided that the above\n"
            "copyright notice and this permission notice appear in all copies.\n\n" + licenses._ISC.split("\n")[1])
    assert licenses.scan_licenses(documents(spark, [(1, text)])).first()["license_id"] == "ISC"


def test_longer_licences_by_their_digest(spark, tmp_path):
    """The texts as a Debian system has them; nothing to compare on others."""
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = {f"/usr/share/common-licenses/{f}": i for f, i in names.items() if os.path.exists(f"/usr/share/common-licenses/{f}")}
    texts = [(k, open(path, encoding="utf-8").read()) for k, path in enumerate(found)]
    out = licenses.scan_licenses(documents(spark, [*texts, (99, "none")])).collect()
    assert {r["doc_id"]: r["license_id"] for r in out} == {**dict(enumerate(found.values())), 99: None}


def test_the_sql_knows_wrapped_and_respelled_licences(spark, tmp_path):
    """The oracle's own lists and rules against the operator on texts that the tables do not hold."""
    import duckdb
    from ledgerflow.llm.oracle_sql import ORACLE
    rows = [(i, t) for i, (_, t) in enumerate(licenses.KNOWN)]
    rows += [(100 + i, "Copyright (c) 2020 A\n(c) and others\nAll rights reserved.\n\n" + "\n".join(textwrap.wrap(t, 50)))
             for i, (_, t) in enumerate(licenses.KNOWN)]
    rows += [(200, MIT.replace("sublicense", "sub-licence")), (201, MIT.replace("sublicense", "sub license")), (202, None), (203, "copyright\nnotice x"),
             (204, "© copyright holders\nx"), (205, MIT.replace("free of charge", "free of charges"))]
    documents(spark, rows, extra=False).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    own = licenses.scan_licenses(spark.read.parquet(f"{tmp_path}/d")).collect()
    columns = ["doc_id", "text_digest", "license_id", "n_notices", "notice_ids"]
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE['op4_license_scan']})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in own) == sorted(theirs, key=lambda r: r[0])


def test_spellings_of_several_words(spark):
    rows = [(i, MIT.replace("sublicense", s)) for i, s in enumerate(["sub-license", "sub license", "sub-\nlicense", "sub-licence", "asub license"])]
    out = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    assert out == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 4: None}


def test_a_conversation_of_thousands_of_turns(spark):
    """More turns than one chunk of the array expressions, with empty texts, control strings and roles of any length."""
    said = [("user" if i % 3 else "assistant", "" if i % 7 == 0 else f"é{i} </s> \\ " * (i % 4)) for i in range(3_000)]
    table = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(said)] + [(2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    done = chat.format_chats(chat.records_from_rows(table))
    out = {r["conv_id"]: r for r in done.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"),
                                                chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == said and out[2]["learned"] == ""
    assert out[1]["learned"] == "".join(t for r, t in said if r == "assistant")
