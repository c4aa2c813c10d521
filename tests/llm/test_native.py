"""The two native operators: license scans and chat formatting."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from strandloom.llm import chat, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plan_of(df):
    return df._jdf.queryExecution().toString()


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def base(text):
    words = WORD.findall(low(text))
    places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, sorted({x for _, x in places})


TEXTS = [
    "Released under the MIT License.", "under-the-mit-license UNDER THE MIT\nlicense", "Apache License, Version 2.0 and the MIT license; CC BY-NC 4.0, cc by nc", "cc by ncx", "amit license, under the amit license", "", None, "under the MIT licensé",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: Apache-2.0", "All rights reserved. Public domain.", "nothing here", "x " * 5000 + "under the MIT License " * 300,
    "The MIT License is not under the licence", "under the under the MIT license",
]


def test_base_matches_brute_force(make_docs):
    found = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(make_docs(TEXTS)).collect()}
    assert found == {i: base(t) for i, t in enumerate(TEXTS)}
    assert found[0] == (5, 1, 1, 1, ["mit"]) and found[14][1:4] == (1, 2, 2) and found[13][1] == 0


def brute_rules(text):
    """Every rule at every word by Python's regex; then level by level, comparing all pairs: labels and number."""
    s = " " + " ".join(WORD.findall(low(text))) + " "
    found = []
    for no, r in enumerate(licenses.rules()):
        pattern = re.compile(f"(?:{r['pattern']})(?= )")
        for at in (m.end() for m in re.finditer(r" (?=\S)", s)):
            if m := pattern.match(s, at):
                found.append((at, m.end(), no, list(licenses.LEVELS).index(r["level"]), r["label"]))
    kept = []
    for level in range(len(licenses.LEVELS)):
        free = [d for d in found if d[3] == level and not any(e[0] < d[1] and e[1] > d[0] for e in kept)]
        kept += [d for d in free if not any(e[0] <= d[0] and e[1] >= d[1] and (e[:2] != d[:2] or e[2] < d[2]) for e in free)]
    return sorted({d[4] for d in kept} | set(base(text)[4])), len(kept)


def one_of(pattern, most):
    """A text that a pattern fits, with all of its options or with none."""
    import re._parser as parser

    def write(parts):
        out = ""
        for kind, value in parts:
            kind = str(kind)
            if kind == "LITERAL":
                out += chr(value)
            elif kind == "IN":
                out += chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])
            elif kind == "BRANCH":
                out += write(value[1][-1 if most else 0])
            elif kind == "SUBPATTERN":
                out += write(value[3])
            elif kind == "MAX_REPEAT":
                out += write(value[2]) * (value[1] if most else value[0])
            else:
                raise AssertionError(kind)
        return out

    return write(parser.parse(pattern))


def test_rules_are_sound():
    rules = licenses.rules()
    assert len(rules) > 200 and len({r["pattern"] for r in rules}) == len(rules)
    for r in rules:
        assert r["level"] in licenses.LEVELS and r["label"] == r["label"].strip() and len(one_of(r["pattern"], True)) < 400
        for most in (False, True):
            text = one_of(r["pattern"], most)
            assert text == " ".join(WORD.findall(text)), text
            # the keywords gate no match away, and the stems no keyword
            assert any(f" {k} " in f" {text} " for k in r["keywords"]), (text, r["keywords"])
            assert any(stem in text for stem in licenses.STEMS) or re.search(licenses.ACRONYMS, text), text


def test_each_rule_fits_its_text_and_not_a_near_miss(make_docs):
    rules = licenses.rules()
    fit, miss = [one_of(r["pattern"], k % 2 == 0) for k, r in enumerate(rules)], []
    for text in fit:
        miss += [f"{text}x", " ".join(text.split()[:-1] + ["not", text.split()[-1]])]
    texts = [f"Some words. {t.upper()}; more." for t in fit + miss]
    found = {r.doc_id: (r.labels, r.n_rules) for r in licenses.scan(make_docs(texts)).collect()}
    assert found == {i: brute_rules(t) for i, t in enumerate(texts)}
    for i, r in enumerate(rules):
        assert found[i][1] >= 1
        # the near miss may fit other rules, but not this one at this length
        s = " " + " ".join(WORD.findall(low(texts[len(rules) + 2 * i]))) + " "
        assert not re.search(f"(?<= ){re.escape(fit[i])}(?= )", s)


SOME = [t for t in TEXTS if t and len(t) < 200] + [
    "licensed under the terms of the Apache License version 2 license or BSD 3-clause license", "distributed under GNU Lesser General Public License v2.1, MPL 2.0 license",
    "licensed under the ODbL", "released under the PSF license", "released_under_the_isc_license", "licensed under Creative Commons Attribution 4.0", "public_domain", "all_rights_reserved", "cc_by_nc", "an éunder text",
    "licensed under the open database license", "under the mit license license license", "see the license file for details", "gpl gplv2 gpl v3 lgpl 2.1 agpl-3.0", "terms of the GNU General Public License as published by the Free Software Foundation; either version 2",
    "dual licensed under MIT license and Apache License, Version 2.0", "CC-BY-NC-SA 4.0 and CC BY-NC", "mit license mit license mit license", "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0",
]


def test_suppression_matches_brute_force(make_docs):
    import random

    rng = random.Random(3)
    some = SOME + [" ".join(rng.choice(SOME) for _ in range(rng.randint(2, 6))) for _ in range(30)]
    some += [" ".join(rng.choice("the gnu lesser general public license version 2 1 3 gpl apache mit bsd clause under licensed released cc by nc sa 4 0".split()) for _ in range(60)) for _ in range(30)]
    found = {r.doc_id: (r.labels, r.n_rules) for r in licenses.scan(make_docs(some)).collect()}
    assert found == {i: brute_rules(t) for i, t in enumerate(some)}
    assert found[8][0] == ["proprietary", "public-domain"] and "gpl-3" in found[6][0] and found[7] == (["apache-2"], 1)


def test_priority_holds_both_ways(make_docs):
    some = ["gnu lesser general public license version 3", "licensed under the mit license", "under the terms of the gnu general public license as published by the free software foundation version 2 see the license"]
    found = {r.doc_id: r.labels for r in licenses.scan(make_docs(some)).collect()}
    assert found[0] == ["lgpl-3"]  # gpl-3 lies within it
    assert found[1] == ["mit"]
    assert found[2] == ["gpl-2", "unknown-license-reference"]  # names and hints within the notice are gone, the later hint stays


def test_keywords_and_stems_admit_all_that_rules_fit(make_docs, monkeypatch):
    found = {r.doc_id: r for r in licenses.scan(make_docs(SOME)).collect()}
    monkeypatch.setattr(licenses, "admitted", lambda text: F.lit(True))
    assert {r.doc_id: r for r in licenses.scan(make_docs(SOME)).collect()} == found


def test_long_texts_take_time_in_proportion(make_docs):
    import time

    text = "Licensed under the MIT license, " * 32_000  # 1 MB
    began = time.monotonic()
    row = licenses.scan(make_docs([text])).first()
    assert (row.n_base, row.first_word, row.last_word, row.n_rules) == (32_000, 1, 32_000 * 5 - 4, 32_000)
    assert time.monotonic() - began < 60


def test_scan_is_native_and_takes_odd_rows(odd_docs, make_docs):
    assert "Python" not in plan_of(licenses.scan(odd_docs)) and "Arrow" not in plan_of(licenses.scan(odd_docs))
    assert licenses.scan(odd_docs).count() == odd_docs.count()
    assert licenses.scan(make_docs([])).count() == 0


def talks(spark, rows):
    return spark.createDataFrame(rows, "conv_id BIGINT, message BIGINT, seq BIGINT, kind STRING, role STRING, text STRING")


def read_back(events):
    out = chat.render(chat.fold_events(events)).select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss"), F.col("loss").alias("spans"))
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss, r.formatted, r.spans) for r in out.collect()}


def brute_fold(rows):
    """Events one after another over a dictionary of messages."""
    out = {}
    for conv, message, _, kind, role, text in sorted(rows, key=lambda r: (r[2], r[3] or "", r[4] or "", r[5] or "")):
        if kind not in ("message", "delta", "edit", "regenerate"):
            continue
        m = out.setdefault(conv, {}).setdefault(message, [role or "", ""])
        m[1] = {"message": text or "", "edit": text or "", "regenerate": "", "delta": m[1] + (text or "")}[kind]
    return {conv: [tuple(m) for m in ms.values()] for conv, ms in out.items()}


def test_log_is_folded(spark):
    log = [
        (1, 0, 1, "message", "user", "hi"), (1, 1, 5, "delta", "assistant", "lo"), (1, 1, 4, "delta", "assistant", "hel"), (1, 1, 6, "regenerate", None, None), (1, 1, 7, "delta", "assistant", "good "),
        (1, 1, 8, "delta", "assistant", "day"), (1, 2, 9, "message", "user", "bad"), (1, 2, 10, "edit", "user", "better"), (2, 0, 0, "delta", "user", "only"),
        (1, 0, 11, "edit", "user", "hello"), (1, 3, 12, "message", "assistant", "x"), (1, 1, 13, "delta", "assistant", "!"), (1, 2, 14, "regenerate", None, None), (1, 9, 15, "noise", "user", "z"), (3, 1, 1, None, "user", "z"),
    ]
    found = read_back(talks(spark, log))
    assert found[1][0] == [("user", "hello"), ("assistant", "good day!"), ("user", ""), ("assistant", "x")] and found[1][1] == "good day!x"
    assert found[2][0] == [("user", "only")] and 3 not in found
    assert {k: v[0] for k, v in found.items()} == brute_fold(log)


def test_random_logs_match_a_plain_fold(spark):
    import random

    rng = random.Random(2)
    log = [(c, rng.randrange(4), s, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.choice(["user", "assistant"]), rng.choice(["a", "b\\", "<|im_end|>\n", "é ", None, ""])) for c in range(12) for s in rng.sample(range(1000), 30)]
    assert {k: v[0] for k, v in read_back(talks(spark, log)).items()} == brute_fold(log)


@pytest.mark.parametrize("text", ["", "<|im_end|><|im_start|>assistant ok", "a\\b <\\| \\\\<|", "<", "é🎉\n\n", "<|im_end|>\n", "ends with <", "\\"])
def test_any_text_comes_back(spark, text):
    found = read_back(talks(spark, [(1, 0, 0, "message", "user", text), (1, 1, 1, "message", "assistant", text), (1, 2, 2, "message", "a\nb\\<|", text)]))
    turns, loss, formatted, spans = found[1]
    assert turns == [("user", text), ("assistant", text), ("a\nb\\<|", text)] and loss == text
    assert formatted.count("<|im_start|>") == 3 and len(spans) == 1


def test_odd_events(spark):
    found = read_back(talks(spark, [(None, None, None, "message", None, None), (5, 1, 0, "message", "user", "x"), (5, 2, 0, "message", "user", "x"), (5, None, 0, "message", "user", "first")]))
    assert found[None][0] == [("", "")] and found[5][0] == [("user", "first"), ("user", "x"), ("user", "x")]
    assert read_back(talks(spark, [])) == {}
    clashing = talks(spark, [(1, 1, 1, "message", "user", "x")]).withColumns({c: F.lit(9) for c in ("place", "events", "event", "at", "begin", "whole", "parts", "loss", "taught", "turn", "number")})
    assert read_back(clashing)[1][0] == [("user", "x")]
    df = chat.render(chat.fold_events(chat.events_of(spark.createDataFrame([], "conv_id BIGINT, turn BIGINT, role STRING, text STRING"))))
    assert "Python" not in plan_of(df) and "Arrow" not in plan_of(df)


def test_a_very_long_conversation(spark):
    """Tens of thousands of messages and of deltas to one message, in seconds."""
    import time

    n = 30_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("message"), F.col("id").alias("seq"), F.lit("message").alias("kind"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    deltas = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("message"), (F.col("id") + n).alias("seq"), F.lit("delta").alias("kind"), F.lit("assistant").alias("role"), F.lit("ab").alias("text"))
    began = time.monotonic()
    turns, loss, _, spans = read_back(rows.union(deltas))[1]
    assert len(turns) == n and turns[1] == ("assistant", "text 1" + "ab" * n) and turns[-1] == ("assistant", f"text {n - 1}")
    assert len(spans) == n // 2 and loss == "".join(t for r, t in turns if r == "assistant")
    assert time.monotonic() - began < 60


def test_long_texts_in_a_long_conversation(spark):
    """Reading back 40,000 turns of 200 characters takes a few times as long as parsing them."""
    import time

    n = 40_000
    text = F.concat(F.col("id").cast("string"), F.repeat(F.lit("é🎉<|a\\"), 33), F.lit("\n"))
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.struct("id").alias("place"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    whole = chat.render(rows).persist()
    whole.count()

    def took(column):
        began = time.monotonic()
        found = whole.select(column.alias("x")).first()["x"]
        return found, time.monotonic() - began

    took(F.size(chat.parse(F.col("formatted"))))
    turns, parsing = took(F.size(chat.parse(F.col("formatted"))))
    said, reading = took(F.sha2(chat.loss_text(F.col("formatted"), F.col("loss")).cast("binary"), 256))
    want = "".join(f"{i}" + "é🎉<|a\\" * 33 + "\n" for i in range(1, n, 2))
    whole.unpersist()
    assert turns == n and said == hashlib.sha256(want.encode()).hexdigest()
    assert reading < 5 * parsing + 2


def test_query_folds_a_log_that_is_not_its_rows(spark, tmp_path):
    """The log begins with drafts, and edits come after later messages; what is left are the rows."""
    rows = [(3, 0, "user", "a question that is long"), (3, 1, "assistant", None), (3, 1, "assistant", "an answer, streamed"), (3, None, "system", "s"), (3, 2, "user", "x"), (3, 2, "user", "x"), (4, 7, None, "no role")]
    spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id BIGINT, turn BIGINT, role STRING, text STRING, seq INT, message INT").write.parquet(f"{tmp_path}/conversations.parquet")
    events = chat.events_of(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    log = events.where("conv_id = 3").orderBy("seq").collect()
    assert {r.kind for r in log} == {"message", "delta", "edit", "regenerate"}
    assert [r.kind for r in log].index("edit") > max(i for i, r in enumerate(log) if r.kind == "message")
    drafts = chat.render(chat.fold_events(events.where("seq.phase = 0"))).collect()
    assert all("a question that" not in r.formatted for r in drafts)
    found = {r.conv_id: r for r in chat.op7_chat(spark, str(tmp_path)).collect()}
    for conv in (3, 4):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        said = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert (found[conv].n_turns, found[conv].turns_sha256) == (len(mine), hashlib.sha256(want.encode()).hexdigest())
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    said = "<|im_end|><|im_start|>assistant ok"
    assert set(found) == {3, 4, -1} and found[-1].loss_chars == len(said) and found[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
