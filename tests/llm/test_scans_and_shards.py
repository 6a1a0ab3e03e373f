import random
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitegraph.llm import license_scan, separator_scan, sharding, sql, url_lists


def test_licenses(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and so on. The above copyright notice and this "
           "permission notice shall be included in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, express or implied.")
    rows = [
        (1, "Text.\nReleased under the MIT License.\nMore text."), (2, mit), (3, "Licensed under the Apache License, Version 2.0. You may not use this file "
         "except in compliance with the License. You may obtain a copy of the License at somewhere"), (4, None), (5, ""), (6, "no words of that kind"),
        (7, "Some unknown license text.\nLicensed under CC BY-NC 4.0."), (8, "This work is licensed under the GNU General Public License, version 3."),
        (8, "This work is licensed under the GNU General Public License, version 3."), (9, "words. " * 100_000 + "\nLicensed under CC BY 4.0."),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, licenses int")
    found = license_scan.scan_licenses(frame)
    got = [(r.doc_id, r.licenses, r.n_unmatched) for r in found.collect()]
    assert got == [(1, ["MIT"], 0), (2, ["MIT"], 0), (3, ["Apache-2.0"], 0), (4, [], 0), (5, [], 0), (6, [], 0), (7, ["CC-BY-NC-4.0"], 1),
                   (8, ["GPL-3.0-only"], 0), (8, ["GPL-3.0-only"], 0), (9, ["CC-BY-4.0"], 0)]
    assert license_scan.scan_licenses(frame.where(F.lit(False))).count() == 0
    assert sorted(found.columns) == ["doc_id", "licenses", "n_unmatched", "sentence_ids", "text"]


MIT_FILE = """MIT License

Copyright (c) 2020 Someone
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
GPL_FILE = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY.
 */"""
APACHE_FILE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
BSD_FILE = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL_FILE = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_licenses_as_they_stand_in_files(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted."
    cases = [
        (MIT_FILE, "MIT"), (GPL_FILE, "GPL-3.0-or-later"), (GPL_FILE.replace("General", "Lesser General").replace("version 3", "version 2.1"), "LGPL-2.1-or-later"),
        (GPL_FILE.replace("General", "Affero General"), "AGPL-3.0-or-later"), (GPL_FILE[: GPL_FILE.index(", either")], "GPL-any"),
        (GPL_FILE.replace("License as published", "License version 2 as published").split(", either")[0], "GPL-2.0-only"),
        ("// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("# SPDX-License-Identifier: (GPL-2.0+ OR BSD-3-Clause)", "BSD-3-Clause,GPL-2.0-or-later"),
        ("It is dual licensed under the MIT License and the Apache License, Version 2.0.", "Apache-2.0,MIT"), ("released under GPLv3 only", "GPL-3.0-only"),
        ("Licensed under either of\n * Apache License, Version 2.0\n * MIT license\nat your option.", "Apache-2.0,MIT"),
        ("This is free and unencumbered software released into the public\ndomain.", "Unlicense"), ("Lizenz: licensed under the EUPL v. 1.2. Ende", "EUPL-1.2"),
        ("Copyright (c) 2001 A. All rights reserved.", "no-licence"), ("Copyright (c) 2001 A. All rights reserved. Licensed under CC0 1.0", "CC0-1.0"),
        (APACHE_FILE, "Apache-2.0"), (BSD_FILE, "BSD-3-Clause"), (MPL_FILE, "MPL-2.0"), (isc, "ISC"), (MIT_FILE.replace("\n", "\r\n"), "MIT"),
        ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"), ("License:\n" + isc, "ISC"),
        ("Licensed under CC BY 4.0\nLicensed under the MIT License\nmore", "CC-BY-4.0,MIT"), ("a license\nover two lines", ""),
    ]
    frame = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: ",".join(r.licenses) for r in license_scan.scan_licenses(frame).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    con = duckdb.connect()
    documents = pa.table({"doc_id": list(range(len(cases))), "text": [text for text, _ in cases]})  # noqa: F841, read by name
    by_sql = {row[0]: row[2] for row in con.execute(sql.oracle()["op3_license_scan"]).fetchall()}
    assert by_sql == got


def test_sentences_of_a_caller_need_no_cue(spark):
    frame = spark.createDataFrame([(1, "The frob shall\nbe shared, version 2.1 or not."), (2, "other")], "doc_id long, matched string")
    got = license_scan.scan_licenses(frame, "matched", [("frob-#", "frob shall be shared # *")], [("Frob", ["frob-2.1"])])
    assert [(r.licenses, r.sentence_ids, r.n_unmatched, r.matched) for r in got.collect()] == [(["Frob"], ["frob-2.1"], 0, frame.first().matched), ([], [], 0, "other")]
    with pytest.raises(ValueError):
        license_scan.scan_licenses(frame, "matched", [("x", "open * inside")])


def test_used_sentences_do_not_join_others(spark):
    known, rules = [("a", "license a"), ("b", "license b"), ("c", "license c")], [("X", ["b", "c"]), ("Y", ["a", "a"])]
    frame = spark.createDataFrame([(1, "license a\nlicense b\nlicense c\nlicense a")], "doc_id long, text string")
    row = license_scan.scan_licenses(frame, known=known, rules=rules).first()
    assert row.licenses == ["X"] and row.n_unmatched == 2


def test_separators_of_any_blocks(spark):
    draw = np.random.default_rng(1)
    files, want = [("none", None), ("empty", b"")], []
    for k in range(30):
        ids = draw.integers(0, 4, draw.integers(0, 60)).astype("<u2")
        files.append((f"f{k}", ids.tobytes() + b"x" * (k % 2)))
        start = n = 0
        for i, value in enumerate(ids):
            if value == 3:
                want.append((f"f{k}", n, start, i - start, True))
                start, n = i + 1, n + 1
        if start < len(ids):
            want.append((f"f{k}", n, start, len(ids) - start, False))
    frame = spark.createDataFrame([(*f, 1) for f in files], "path string, content binary, block int")
    for block in (1, 7, 64):
        assert sorted(map(tuple, separator_scan.document_lengths(frame, 3, block).collect())) == sorted(want)
    assert separator_scan.document_lengths(frame.where(F.lit(False)), 3).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    texts = [None, "", "one two", "<|endoftext|>", "long " * 30_000, "one two"]
    frame = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, path int").coalesce(1)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    files = separator_scan.token_files(frame, ranks, public_tokenizers.PATTERN, 50256, file_tokens=10)
    encoder = separator_scan.RankEncoder(ranks, public_tokenizers.PATTERN)
    lengths = [len(encoder.encode(t or "")) for t in texts]
    for i, r in enumerate(files.collect()):
        (tmp_path / f"{i}.bin").write_bytes(r.content)
    for source in (files, separator_scan.read_token_files(spark, str(tmp_path))):
        rows = separator_scan.document_lengths(source, 50256, 1000).collect()
        assert sorted(r.n_tokens for r in rows) == sorted(lengths) and all(r.closed for r in rows)


def test_token_file_beyond_the_limit_of_a_row(spark, tmp_path):
    length, ends = (1 << 31) + (1 << 20) + 1, [5, 1 << 20, (1 << 30) + 7]
    with open(tmp_path / "long name%20.bin", "wb") as file:
        for end in ends:
            file.seek(2 * end)
            file.write((3).to_bytes(2, "little"))
        file.truncate(length)  # the rest is a hole
    listed = separator_scan.read_token_files(spark, str(tmp_path))
    assert separator_scan.ranges_of(listed).rdd.getNumPartitions() == 33
    got = sorted((r.start, r.n_tokens, r.closed) for r in separator_scan.document_lengths(listed, 3, 1 << 20).collect())
    starts = [0, *(end + 1 for end in ends)]
    assert got == [(a, b - a, b < length // 2) for a, b in zip(starts, [*ends, length // 2])]


def test_url_lists(spark):
    draw = random.Random(3)
    hosts, start = ["a.org", "x.a.org", "y.x.a.org", "b.org", "hot.com"], datetime(2023, 11, 1)
    day = lambda: start + timedelta(days=draw.randrange(200))
    host = lambda: draw.choice(hosts + ["hot.com"] * 5)
    captures = [(i, f"http://{host()}{draw.choice(['', '/', '/p', '/p/q', '/p/q/r?x=/z', '#f'])}", day() + timedelta(hours=5), "v") for i in range(300)]
    captures += [(900, None, day(), "v"), (901, "http://a.org/", None, "v"), (902, "no url", day(), "v"), captures[0], captures[0]]
    entries = [(draw.choice(["block", "allow"]), host() + draw.choice(["", "/p", "/p/q"]), draw.choice(["add", "add", "remove"]), day().date()) for _ in range(250)]
    entries += [entries[0], (None, "a.org", "add", day().date()), ("block", None, "add", day().date()), ("block", "a.org", "other", day().date())]

    def verdict(url, at):
        if not url or not at or "://" not in url:
            return "none", None, None
        path = url.split("://")[1].split("?")[0].split("#")[0].split("/")
        labels, parts = path[0].split("."), [p for p in path[1:] if p]
        keys = ["/".join([path[0], *parts[:n]]) for n in range(len(parts), 0, -1)] + [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))]
        for key in keys:
            for name in ("block", "allow"):
                past = [(e[3], e[2]) for e in entries if e[:2] == (name, key) and e[2] in ("add", "remove") and e[3] <= at.date()]
                if past and max(past)[1] == "add":
                    return name, key, max(past)[0]
        return "none", None, None

    frame = spark.createDataFrame(captures, "page_id int, url string, fetched_at timestamp, verdict string").repartition(3)
    listed = spark.createDataFrame(entries, "list string, key string, action string, day date")
    got = url_lists.judge_captures(frame, listed)
    assert sorted(((r.page_id, r.verdict, r.rule_key, r.rule_since) for r in got.collect()), key=str) == sorted(
        ((i, *verdict(url, at)) for i, url, at, _ in captures), key=str)
    none = url_lists.judge_captures(frame, listed.where(F.lit(False)))
    assert none.count() == len(captures) and none.where("verdict <> 'none'").count() == 0
    assert url_lists.judge_captures(frame.where(F.lit(False)), listed).count() == 0
    from pyspark.sql.utils import AnalysisException  # noqa: F401

    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.fixture(scope="module")
def sharded(spark):
    draw = random.Random(5)
    rows = [(i, "".join(draw.choices("ab é", k=draw.randint(0, 400)))) for i in range(4000)]
    rows += [(10_000 + i, "the same text of a third of all rows " * 3) for i in range(2000)] + [(None, None), (None, "x"), (7, rows[7][1]), (20_000, "long " * 4000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(5)
    return rows, sharding.shard_documents(frame, bins=8).collect()


def test_shards_hold_everything_once(sharded):
    rows, got = sharded
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((d or -1, len((t or "").encode()) + 8) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_balanced(sharded):
    rows, got = sharded
    sizes, counts = np.zeros(8), np.zeros(8)
    for r in got:
        sizes[r.shard] += r["size"]
        counts[r.shard] += 1
    assert sizes.max() / sizes.min() < 1.01 and counts.max() / counts.min() < 1.05


def test_groups_stay_together_unless_large(sharded):
    rows, got = sharded
    texts = dict(rows[:4000])
    at = defaultdict(set)
    for r in got:
        if r.doc_id in texts:
            at[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in at.values())


def test_empty_tables_have_no_shards(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_documents(frame).collect() == []


def test_packing_takes_the_best_dot_product():
    draw = np.random.default_rng(0)
    items, weights = draw.random((200, 3)) * 0.03, np.array([1.0, 0.5, 0.2])
    chosen = sharding.pack(items, 5, weights)
    room = np.ones((5, 3))
    for i in sorted(range(200), key=lambda i: (-(items[i] * weights).max(), i)):
        scores = [float(room[b] @ (items[i] * weights)) for b in range(5)]
        assert scores[chosen[i]] >= max(scores) - 1e-12
        room[chosen[i]] -= items[i]
