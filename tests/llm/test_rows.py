"""Row-local operators and packing against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lurewatch.llm import decontaminate, licences, pack, pii, quality, shards
from lurewatch.llm.vocab import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_packing(request, table):
    df = request.getfixturevalue(table)
    rows, texts = pack.pack_documents(df).collect(), [(r.doc_id, r.text or "") for r in df.collect()]
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for doc, text in texts:
        ids = tok.encode(text, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            p = ids[k:k + 4096]
            want.append((doc, k // 4096, k, len(p), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p))))
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=order) == sorted(want, key=order)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1
    assert pack.pack_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_quality_base(request, table):
    df = request.getfixturevalue(table)
    texts = Counter()
    for r in df.collect():
        t = r.text or ""
        w = WORD.findall(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {i + k for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        texts[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed] += 1
    got = quality.quality_rules(df).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == texts
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.keep_quality(df).count() == sum(r.kept for r in got)
    assert quality.keep_quality(df).columns == df.columns and quality.quality_rules(df.limit(0)).count() == 0


def test_quality_keeps_good_labels(docs, spark, sf):
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1")
    lost = quality.quality_rules(docs).filter("not base_failed and not kept").join(good, "doc_id")
    assert lost.count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, value):
    d = [int(c) for c in value if c.isdigit()]
    luhn = sum(x if i % 2 == 0 else (2 * x) // 10 + (2 * x) % 10 for i, x in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")),
            "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def test_pii(spark, docs, odd):
    hard = spark.createDataFrame([
        (1, "é a@b.c@d.e.f x+1_a-@x.y-z. 1.2.3.4.5.6.7.8 999.1.2.3.4 01.002.3.255 256.1.1.1"), (2, "a@b.com_x@y.com..z@q.r+1 (22) 333-4444"),
        (3, "5-4111111111111111 4111111111111111-5 4111111111111111--4111111111111111 \U0001F600 4111 1111 1111 1111")], "doc_id long, text string")
    for df in (hard, docs, odd):
        want = Counter((r.doc_id, ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items()
                                           for m in re.finditer(p, r.text or "") if _valid(k, m.group(0)))) for r in df.collect())
        found = pii.find_pii(df)
        assert Counter((r.doc_id, r.b) for r in found.select("doc_id", pii.joined(F.col("base")).alias("b")).collect()) == want
    assert pii.find_pii(odd.limit(0)).count() == 0
    out = {r.doc_id: r.text for r in pii.redact(odd.filter("doc_id = 8")).collect()}
    assert out[8].startswith("Mail [EMAIL] or [PHONE] from [IP]. Released")


def test_pii_bootstrap_finds_context(spark):
    seeds = [(i, f"please call badge {'4111111111111111' if i == 0 else f'a{i}@b.org'} now") for i in range(12)]
    df = spark.createDataFrame(seeds + [(99, "please call badge ZX99-1234 now"), (100, "chapter 10-20-30 ends")], "doc_id long, text string")
    got = {r.doc_id: [s.value for s in r.spans if s.kind == "id"] for r in pii.find_pii(df).collect()}
    assert got[99] == ["ZX99-1234"] and got[100] == []


def test_pii_bootstrap_goes_on(spark):
    """Discovered identifiers admit a pattern without seeds, however many unseen ones a pattern has."""
    ids = [f"ZX{k}-12{k}4" for k in range(10, 50)]
    rows = [f"please call badge a{i}@b.org now" for i in range(6)] + [f"please call badge {v} now" for v in ids]
    rows += [f"the visitor pass {v} was shown" for v in ids[:6]] + ["the visitor pass QQ77-8899 was shown"]
    rows += ["a locker key QQ77-8899 is kept", "chapter 10-20-30 ends"]
    rows += [f"rooms near {v} are" for v in ids[:6]] + [f"rooms near {k} are" for k in range(6)] + ["rooms near 99-88-77 are"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    spans = lambda **o: {r.doc_id: [s.value for s in r.spans if s.kind == "id"] for r in pii.find_pii(df, **o).collect()}
    got = spans()
    found = {rows[k]: v for k, v in got.items() if v}
    assert found == {t: [t.split()[3]] for t in rows if ("badge ZX" in t or "visitor pass" in t)}
    assert {rows[k].split()[2] for k, v in spans(rounds=1).items() if v} == {"badge"}


def test_licences(odd):
    got = {(r.unit, r.number, r.licence) for r in licences.scan_licences(odd).collect()}
    assert got == {("line", 1, "MIT notice")}
    assert licences.scan_licences(odd.limit(0)).count() == 0


def test_decontamination(spark, odd):
    item = "If Anna drives 120 km in 2 hours how far does she get with the same speed in 5 hours on this road"
    other = item.replace("120", "90").replace("2 hours", "3 hours").replace("5 hours", "7 hours")
    clash = item.replace("120", "90")
    rows = [(1, f"some words before {item} and after"), (2, other), (2, other), (3, "nothing of the kind is here at all but some plain words"),
            (None, item), (5, None), (6, "")]
    df, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")
    got = {r.doc_id: r.n_changed for r in decontaminate.contaminated(df, items).collect()}
    assert got[1] == 0 and got[2] > 0 and None in got and set(got) == {1, 2, None}
    assert [r.doc_id for r in decontaminate.without_contaminated(df, items).orderBy("doc_id").collect()] == [3, 5, 6]
    assert decontaminate.contaminated(odd, items).count() == 0 and decontaminate.contaminated(df, items.limit(0)).count() == 0


def test_decontamination_drops_only_clashing_windows(spark):
    """One edited value takes its own windows away, not the item's others."""
    item = ("If Anna drives 120 km in 2 hours how far does she get with the same speed in 5 hours on this road "
            "when after 2 more stops the old car has to wait for the slow train at the long bridge")
    roles = ("A farmer sells 2 apples and 2 pears at the market in the morning and then walks home along the river "
             "to feed the hens before the sun goes down")
    rows = [(1, item.replace("120", "90")), (2, item.replace("after 2 more", "after 4 more")),
            (3, roles.replace("2 apples", "3 apples").replace("2 pears", "5 pears")), (4, item), (5, roles),
            (6, "We saw 3 apples and 5 pears at the market in the town")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, roles)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(df, items).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    n, m = len(item.split()), len(roles.split())
    words = lambda k: (got[k].item_id, got[k].n_words, got[k].n_windows, got[k].n_changed, got[k].position)
    # the item's first two windows have too few plain words
    assert words(4) == (7, n - 2, n - 9, 0, 2) and words(1) == (7, n - 2, n - 9, 1, 2) and words(5) == (8, m, m - 7, 0, 0)
    assert words(2) == (7, n - 3, n - 9 - 8, 0, 2)      # the eight windows over the edited place are lost
    assert words(3) == (8, m - 7, m - 7 - 7, 0, 7)
    assert [r.doc_id for r in decontaminate.without_contaminated(df, items).collect()] == [6]


def test_shards(odd, docs):
    for df in (odd.drop("shard"), docs, odd.limit(0)):
        rows = shards.interleave(df, shards=4).collect()
        assert len(rows) == df.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert not rows or max(map(len, slots.values())) - min(len(slots.get(k, [])) for k in range(4)) <= 1
