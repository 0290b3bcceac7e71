"""Operators that make tables of numbers: mixing, sharding, packing, licence scan."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import base
from lexloom.llm import curriculum as cu
from lexloom.llm import license_scan as ls
from lexloom.llm import packing as pk
from lexloom.llm import queries as q
from lexloom.llm import sharding as sh

ODD = [
    (1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "word " * 400, None), (5, "a b c", "y"), (5, "a b c", "y"), (None, "é ß\tz", "z"), (7, " \n ", "x"), (8, "w " * 3000, "y"),
]
SCHEMA = "doc_id long, text string, source string"


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as size", "2 as target", "3 as shard", "4 as rank", "5 as length", "'k' as code", "6 as __bucket")


def same(found, sql, d):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    expected = con.sql(sql).df()
    c = sorted(expected.columns)
    key = lambda frame: sorted(map(str, frame[c].astype(object).where(frame[c].notna(), None).values.tolist()))
    assert sorted(found.columns) == c and key(found) == key(expected)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, small, name):
    same(q.queries()[name](spark, small).toPandas(), q.oracle_sql()[name], small)


def test_curriculum_odd_rows(spark):
    rows = cu.curriculum(odd(spark)).collect()
    assert len(rows) == len(ODD)
    total = sum(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        assert 0 <= len(r["positions"]) <= 2 and all(0 <= p <= 1 for p in r["positions"])
        source = {1: "x", 2: "x", 7: "x", 5: "y", 8: "y", None: "z", 3: None, 4: None}[r["doc_id"]]
        by[source, r["target"], r["source_size"]].append(r["size"] * len(r["positions"]))
    assert len(by) == 4 and sum(t for _, t, _ in by) == pytest.approx(1.5 * total)
    for (_, target, source), taken in by.items():
        assert target <= 2 * source and abs(sum(taken) - target) <= max(r["size"] for r in rows) / 2
    assert cu.curriculum(odd(spark, [])).count() == 0
    assert sorted(map(str, cu.curriculum(odd(spark)).collect())) == sorted(map(str, rows))


def test_mix_is_the_same_in_any_order(spark):
    """Rows of one id and size with other texts."""
    rows = [(7, f"{w} {w} {w}", "x") for w in ("ant", "bee", "cat", "dog")] + [(8, "one two", "x"), (None, "no id here", "x"), (None, "id no here", "x")]
    mixes = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(order, SCHEMA).withColumn("a.b", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.col("text")))
        mixed = cu.training_order(cu.curriculum(docs, keep=True)).select("document.text", "position").collect()
        mixes.add(tuple(sorted(map(tuple, mixed))))
    assert len(mixes) == 1 and len(next(iter(mixes))) > 5


def test_schedule_inverse(spark):
    for place, knots in enumerate(cu.SCHEDULES):
        t = np.linspace(0, 1, 4001)
        w = np.interp(t, *zip(*knots))
        demand = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        demand /= demand[-1]
        ys = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
        df = spark.createDataFrame([(y, place) for y in ys], "y double, place int")
        got = [r[0] for r in df.select(cu.invert_demand(df.y, df.place)).collect()]
        assert got == pytest.approx(np.interp(ys, demand, t).tolist(), abs=1e-3)


def test_training_order(spark):
    mixed = cu.curriculum(odd(spark), keep=True)
    rows = cu.training_order(mixed, 3).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    assert rows[0]["document"]["shard"] == 3


def test_schedule_of_jobs_is_longest_first():
    random.seed(2)
    jobs = [(random.randrange(1, 100), f"j{i}") for i in range(200)]
    loads = [0] * 5
    for size, name in sorted(jobs, key=lambda j: (-j[0], j[1])):
        loads[loads.index(min(loads))] += size
    found = Counter()
    sizes = {n: s for s, n in jobs}
    for name, s in sh.schedule(jobs, 5):
        found[s] += sizes[name]
    assert sorted(found.values()) == sorted(loads)


def test_sharding_odd_rows(spark):
    rows = sh.assign_shards(odd(spark), shards=3, fine=4).collect()
    assert len(rows) == len(ODD)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        groups[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter(str((len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for _, t, _ in ODD)
    assert Counter(str((r["size"], r["text_crc32"])) for r in rows) == sizes
    assert all(len(s) == 1 for k, s in groups.items() if k[0] > 1)
    assert sh.assign_shards(odd(spark, [])).count() == 0


def test_sharding_whole_assignment(spark, small):
    """The query's shards are those of longest-first scheduling by plain loops; loads are as near as that bounds them."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    size = lambda t: len((t or "").encode()) + 1
    groups: Counter = Counter()
    for r in docs:
        groups[r["text"]] += size(r["text"])
    total = sum(groups.values())
    rows = q.op6_lpt_sharding(spark, small).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs) and all(by_id[r["doc_id"]]["size"] == size(r["text"]) and by_id[r["doc_id"]]["text_crc32"] == zlib.crc32((r["text"] or "").encode()) for r in docs)
    shards: dict = {}
    for r in docs:
        assert shards.setdefault(r["text"], by_id[r["doc_id"]]["shard"]) == by_id[r["doc_id"]]["shard"]
    load: Counter = Counter(dict.fromkeys(range(16), 0))
    for t, n in groups.items():
        load[shards[t]] += n
    # longest first: when the heaviest shard got its last job it was the lightest
    heaviest = max(load, key=load.get)
    bundle = max(total / (16 * 512), min(n for t, n in groups.items() if shards[t] == heaviest))
    assert load[heaviest] <= total / 16 + max(bundle, max(n for t, n in groups.items() if shards[t] == heaviest)) and set(load) == set(range(16))
    # the small table's groups are all scheduled one by one or in bundles of one, so the plan is that of plain loops
    jobs, plain = sorted(groups.values(), reverse=True), [0] * 16
    for n in jobs:
        plain[plain.index(min(plain))] += n
    assert max(load.values()) <= 1.02 * max(plain)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_positions_are_numeric_inversions(spark, small):
    docs = [(r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = {r["doc_id"]: r for r in q.op5_curriculum(spark, small).collect()}
    import hashlib

    names = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    t = np.linspace(0, 1, 20_001)
    for place, name in enumerate(names):
        w = np.interp(t, *zip(*cu.SCHEDULES[place % 3]))
        demand = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        own = sorted((d for d in docs if d[1] == name), key=lambda d: (hashlib.md5(str(d[0]).encode()).hexdigest(), d[2]))
        before, every = 0, sum(d[2] for d in own)
        for i, _, n in own:
            r = found[i]
            for k, got in enumerate((r["first_position"], r["second_position"])):
                share = (before + n / 2 + k * every) / r["target"]
                want = np.interp(share, demand / demand[-1], t) if share < 1 and n else None
                assert got == (pytest.approx(want, abs=1e-4) if want is not None else None)
            before += n


def test_tokenizer_files_of_other_kinds(tmp_path):
    import json

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert pk._plain_byte_pairs(path)
    spec = json.loads(open(path, encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"model": {**spec["model"], "merges": spec["model"]["merges"][1:] + spec["model"]["merges"][:1]}}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps({**spec, **change}), encoding="utf-8")
        assert not pk._plain_byte_pairs(str(other))
    pk._tokenizer.cache_clear()
    assert pk._tokenizer(str(other))[1] is None
    ids = pk._tokenizer(str(other))[0].encode("plain words, 12 of them", add_special_tokens=False).ids
    assert np.frombuffer(pk.token_bytes(["plain words, 12 of them"], str(other))[0], "<u4").tolist() == ids


def test_tokens_agree_between_libraries():
    exact = pk._tokenizer(None)[0]
    random.seed(3)
    pool = [*range(32, 127), *range(9, 14), 32, 32, 10, 0xA0, 0xE9, 0x3000, 0x4E2D, 0x1F600, 0x85, 0x1C, 0x301]
    texts = ["", None, " ", "a  b \n c", "<|endoftext|> x", "x" * 5000] + ["".join(chr(random.choice(pool)) for _ in range(random.randrange(1, 40))) for _ in range(2000)]
    for t, b in zip(texts, pk.token_bytes(texts)):
        assert np.frombuffer(b, "<u4").tolist() == exact.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" " * 1_000_100, "\n" * 1_000_100 + "a", "x " + "\u3000" * 1_000_100 + " y"])
def test_tokens_of_long_runs_of_blanks(run):
    exact = pk._tokenizer(None)[0]
    assert np.frombuffer(pk.token_bytes([run])[0], "<u4").tolist() == exact.encode(run, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    random.seed(seed)
    capacity = random.choice([64, 256])
    histogram = Counter(min(capacity, max(1, int(random.expovariate(1 / (capacity * random.choice([0.1, 0.4, 0.8])))))) for _ in range(random.choice([1, 7, 3000])))
    groups = random.choice([2, 8, 64])
    rows = pk.plan_packing(histogram, capacity, groups=groups)
    fill, taken = Counter(), Counter()
    for length, a, b, first, stride in rows:
        taken.update(dict.fromkeys([length], b - a) if b > a else {})
        for r in range(a, b):
            fill[first + (r - a) // stride] += length
    ranks = defaultdict(list)
    for length, a, b, *_ in rows:
        ranks[length] += range(a, b)
    assert all(sorted(ranks[k]) == list(range(n)) for k, n in histogram.items()) and taken == histogram
    assert max(fill.values()) <= capacity
    lower = -(-sum(k * n for k, n in histogram.items()) // capacity)
    halves = sum(n for k, n in histogram.items() if 2 * k > capacity)
    assert len(fill) <= (1.03 if groups == 64 else 2) * max(lower, halves) + 2  # few groups round up far
    assert pk.plan_packing({}, capacity) == []


def check_packing(rows, docs, capacity=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for (i, text), copies in Counter(docs).items():
        ids = pk.token_bytes([text])[0] + bytes(4)
        parts = sorted(by_doc[i], key=lambda r: (r["piece"], r["sequence_id"]))[::copies]
        assert sum(p["length"] for p in parts) == len(ids) // 4 and [p["piece"] for p in parts] == list(range(len(parts)))
        for p in parts:
            assert p["ids_crc32"] == zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])])
        assert all(p["length"] == capacity for p in parts[1:])


def test_packing_odd_rows(spark):
    rows = pk.pack(odd(spark), capacity=128, groups=4).collect()
    check_packing(rows, [(i, t) for i, t, _ in ODD], 128)
    assert pk.pack(odd(spark, [])).count() == 0


MIT = "x y z.\n" + ls.SENTENCES["mit-grant"].replace("without restriction", "without\nrestriction") + "\n\n" + ls.SENTENCES["mit-notice"] + "\n" + ls.SENTENCES["mit-warranty"] + " " + ls.SENTENCES["mit-liability"]


def test_licences(spark):
    texts = [
        (1, MIT), (2, "junk ### %%\nReleased under the MIT License.\nmore"), (3, None), (4, ""), (5, "See the GNU General Public License for more details."),
        (6, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."), (7, "A licence of no kind."), (8, "SPDX-License-Identifier: Apache-2.0"), (8, "SPDX-License-Identifier: Apache-2.0"),
        (None, "All rights reserved."), (9, SENTENCES["GPL-3.0 grant 0 program"] + "\n" + "filler.\n" * 20 + SENTENCES["warranty program"]),
    ]
    found = {(r["doc_id"], r["licence"]): r["matches"] for r in ls.scan_licences(odd(spark, [(i, t, "s") for i, t in texts])).collect()}
    assert found == {
        (1, "MIT"): 1, (2, "MIT"): 1, (5, ls.UNMATCHED): 1, (6, "CC-BY-NC-4.0"): 2, (8, "Apache-2.0"): 1, (None, "All-Rights-Reserved"): 1, (9, "GPL-3.0-or-later"): 1, (9, ls.UNMATCHED): 1,
    }
    assert ls.scan_licences(odd(spark, [])).count() == 0


def take_tags(text):
    """The text without its tags, and their expressions, read token by token."""
    known = {k.lower(): k for k in ls.cited()}
    name, out, tags, at = "spdx-license-identifier:", [], [], 0
    while at < len(text):
        if text[at : at + len(name)].lower() != name:
            out.append(text[at])
            at += 1
            continue
        end = at + len(name)
        line = text[end:].split("\n")[0]
        parts, want_id, i = [], True, 0
        while True:
            gap = len(line[i:]) - len(line[i:].lstrip(" \t"))
            j = i + gap
            while j < len(line) and (line[j] in "()+.-" or (line[j].isalnum() and line[j].isascii())):
                j += 1
            token = line[i + gap : j]
            if want_id:
                while token and token.rstrip(")")[-1:] in (".", "-"):  # the end of a sentence is no part of a name
                    token = token.rstrip(")")[:-1]
                if not token.strip("()"):
                    break
                parts.append(token)
                i += gap + len(token)
                if i < j:
                    break
            elif gap and token in ("AND", "OR", "WITH"):
                parts.append(token)
                i = j
            else:
                break
            want_id = not want_id
        if parts and parts[-1] in ("AND", "OR", "WITH"):
            i -= len(parts.pop())
        if parts:
            tags.append(" ".join(known.get(x.lower(), x) for x in parts))
            out.append(" ")
            at = end + i
        else:
            out.append(text[at])
            at += 1
    return "".join(out), tags


def usual_wording(words):
    """Owners' names give way to the usual wording, slot by slot."""
    for before, after, usual in ls.SLOTS:
        b, a, i = before.split(), after.split(), 0
        while i < len(words):
            if words[i : i + len(b)] == b:
                for n in range(1, ls.SLOT_WORDS + 1):
                    j = i + len(b) + n
                    if words[j : j + len(a)] == a:
                        words = words[: i + len(b)] + usual.split() + words[j:]
                        break
            i += 1
    return words


def naive_licences(text):
    """Tags by hand, then known sentences word by word, the longest first; then the rules over lists, one match at a time."""
    text, tags = take_tags(text or "")
    for short in ("AGPL", "LGPL", "GPL"):
        for v in ("2", "3", "v2", "v3", "v2.1", "v3.0", "v2.0"):
            text = text.replace(f" {short}{v}+", f" {short}{v} or later")
    words = usual_wording(ls.normalise(text).split())
    known = {tuple(s.split()): c for s, c in ls.known_sentences()}
    longest = max(map(len, known))
    at, codes, end = 0, [], None
    while at < len(words):
        hit = next((tuple(words[at : at + n]) for n in range(longest, 0, -1) if tuple(words[at : at + n]) in known and at + n <= len(words)), None)
        if hit is None:
            at += 1
            continue
        codes += ["_"] * (end is not None and at - end > ls.GAP) + [known[hit]]
        at = end = at + len(hit)
    out = Counter(tags)
    for licence, rule in ls.rules():
        want = [x + ">" for x in rule.split(">")[:-1]]
        i = 0
        while i < len(codes):
            if codes[i : i + len(want)] == want:
                codes[i : i + len(want)] = ["#"]
                out[licence] += 1
            i += 1
    out[ls.UNMATCHED] += sum(c.startswith("<") for c in codes)
    return {k: n for k, n in out.items() if n}


SENTENCES = ls.SENTENCES | ls.gnu_notices()[0]


def test_licences_of_owners_expressions_and_gnu_notices(spark):
    one_line = lambda *names: " ".join(SENTENCES[n] for n in names)
    bsd = one_line("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty", "bsd-liability")
    cases = {
        bsd.replace("the name of the copyright holder", "the name of Foo Inc."): {"BSD-3-Clause": 1},
        bsd.replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS"): {"BSD-3-Clause": 1},
        "SPDX-License-Identifier: BSD-3-Clause-Clear": {"BSD-3-Clause-Clear": 1}, "// spdx-license-identifier: gpl-3.0-or-later\n": {"GPL-3.0-or-later": 1},
        "SPDX-License-Identifier: 0BSD.": {"0BSD": 1}, "x SPDX-License-Identifier: GPL-2.0-only OR MIT */": {"GPL-2.0-only OR MIT": 1},
        "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception\nand": {"Apache-2.0 WITH LLVM-exception": 1}, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND CC0-1.0": {"(MIT OR Apache-2.0) AND CC0-1.0": 1},
        "SPDX-License-Identifier: MIT or so": {"MIT": 1}, "SPDX-License-Identifier:\nlicense": {},
        "Licensed under GPLv3 or later": {"GPL-3.0-or-later": 1}, "Licensed under GPLv3+.": {"GPL-3.0-or-later": 1}, "Licensed under GPLv2.": {"GPL-2.0-only": 1},
        "Licensed under the GNU General Public License, version 2 or (at your option) any later version.": {"GPL-2.0-or-later": 1},
        one_line("LGPL-2.1 grant 0 library", "warranty library", "details lesser-general", "copy lesser-general library"): {"LGPL-2.1-or-later": 1},
        one_line("AGPL-3.0 grant 0 program", "warranty program", "details affero-general", "copy affero-general program"): {"AGPL-3.0-or-later": 1},
        one_line("GPL-2.0 grant 3 program") + " only": {"GPL-2.0-only": 1}, one_line("mpl-grant", "mpl-copy-https"): {"MPL-2.0": 1}, one_line("0bsd-grant", "isc-warranty", "isc-liability"): {"0BSD": 1},
        one_line("apache-title"): {"Apache-2.0": 1}, one_line("GPL-3.0 title"): {"GPL-3.0-only": 1},
        "neither the name of " + "x " * 13 + "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": {},
    }
    found = defaultdict(dict)
    for r in ls.scan_licences(odd(spark, [(i, t, "s") for i, t in enumerate(cases)])).collect():
        found[r["doc_id"]][r["licence"]] = r["matches"]
    for i, (t, want) in enumerate(cases.items()):
        assert found[i] == want, t
        assert naive_licences(t) == want, t


def test_licences_of_the_table(spark, small):
    """Every document against the second implementation."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    found = defaultdict(dict)
    for r in q.op2_license_scan(spark, small).collect():
        found[r["doc_id"]][r["licence"]] = r["matches"]
    near = [r for r in docs if r["text"] and any(a in r["text"].lower() for a in ls.ANCHORS)]
    assert len(near) > 3 and set(found) <= {r["doc_id"] for r in near}
    for r in near:
        assert found[r["doc_id"]] == naive_licences(r["text"]), r["doc_id"]


def test_licences_in_flattened_and_long_texts(spark):
    one_line = lambda *names: " ".join(SENTENCES[n] for n in names)
    texts = [
        one_line("mit-grant", "mit-notice", "mit-warranty", "mit-liability"),
        one_line("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty", "bsd-liability"),
        one_line("bsd-grant") + " 1. " + one_line("bsd-source") + " 2. " + one_line("bsd-binary"),
        "Copyright 2020 X, licensed under the MIT License. More text",
        ls.SENTENCES["mit-liability"].replace(" ", "\n"),
        "Licensed under the Apache License, Version 2.0 and more", ls.SENTENCES["apache-grant"],
        "relicensed under the mit license", "licensed under the mit licenses", "All rights reserved." * 50,
        one_line("GPL-3.0 grant 0 program") + " x" * ls.GAP + one_line("warranty program"), one_line("GPL-3.0 grant 0 program") + " x" * (ls.GAP + 1) + one_line("warranty program", "details general", "copy general program"),
        "a line of no kind\n" * 200_000 + one_line("isc-grant") + "\npublic word\n" * 200_000 + "SPDX-License-Identifier: ISC",
        "Licensed under CC0 1.0 Universal. Licensed under CC0 1.0. Released under the Unlicense",
    ]
    found = defaultdict(dict)
    for r in ls.scan_licences(odd(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect():
        found[r["doc_id"]][r["licence"]] = r["matches"]
    for i, t in enumerate(texts):
        if i == 12:
            assert found[i] == {"ISC": 2}
        else:
            assert found[i] == naive_licences(t), t[:80]
    assert found[0] == {"MIT": 1} and found[1] == {"BSD-3-Clause": 1} and found[3] == {"MIT": 1} and found[7] == found[8] == {}


def test_licence_anchors():
    assert all(any(a in s for a in ls.ANCHORS) for s, _ in ls.known_sentences())


@pytest.mark.parametrize("least", [1, 2048])
def test_sizes_of_buckets_change_nothing(spark, small, least):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    mixed = lambda n: {(r["doc_id"], tuple(r["positions"])) for r in cu.curriculum(docs, least_per_bucket=n).collect()}
    assert mixed(least) == mixed(50)
    slots = defaultdict(list)
    for r in sh.assign_shards(docs, 4, least_per_bucket=least).collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == docs.count()
    assert base.rows_per_bucket(10**10) == 10**5 and base.rows_per_bucket(10**6) == 2048
