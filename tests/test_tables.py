"""Suffix rules, dictionaries, quantile buckets, versioned tables, hosts: against plain Python."""

import csv
import ipaddress
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from lurewatch.dims import Dims
from lurewatch.functions import hosts as H
from lurewatch.functions import urls as U
from lurewatch.functions.suffixes import suffix_rules
from lurewatch.operators import joins as J
from lurewatch.operators import metrics as M
from lurewatch.operators import ranks as R
from lurewatch.plans.url_features import url_features_v2
from lurewatch.sources import readers as RD
from lurewatch.sources import versioned as VT


def frame(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_suffix_rules(spark):
    rules = suffix_rules(frame(spark, ["// comment", "", "com", "gov.ng", "ac.ke", "co.hu", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp"], "value"))
    want = {"a.b.gov.ng": "b.gov.ng", "x.uni.ac.ke": "uni.ac.ke", "shop.co.hu": "shop.co.hu", "co.hu": "", "foo.any.ck": "foo.any.ck",
            "any.ck": "", "www.ck": "www.ck", "a.www.ck": "www.ck", "a.b.kawasaki.jp": "a.b.kawasaki.jp", "x.city.kawasaki.jp": "city.kawasaki.jp",
            "b.kawasaki.jp": "", "plain.org": "plain.org", "10.0.0.1": "", "localhost": "", "A.Gov.NG.": "a.gov.ng", "com": ""}
    df = frame(spark, [f"https://{h}/p" for h in want], "url")
    got = {r.url[8:-2]: r.registered for r in U.registered_domain(df, suffixes=rules).collect()}
    assert got == want
    none = suffix_rules(frame(spark, [], "value"))
    assert {r.registered for r in U.registered_domain(df.filter("url like '%plain%'"), suffixes=none).collect()} == {"plain.org"}


def test_suffix_table_of_any_length(spark):
    rules = suffix_rules(spark.range(60_000).select(F.concat(F.lit("s"), "id", F.lit(".tld")).alias("value")))
    df = frame(spark, ["http://a.b.s59999.tld/", "http://a.b.s60000.tld/"], "url")
    assert sorted(r.registered for r in U.registered_domain(df, suffixes=rules).collect()) == ["b.s59999.tld", "s60000.tld"]


def test_dictionary_features(spark):
    words = frame(spark, ["smart", "home", "Portfolio", "next", "cat"], "word")
    urls = {"https://mysmarthome.pages.dev/": 0.0, "https://myportfolio.pages.dev/": 0.0, "https://3rf3x34x.pages.dev/": 0.0,
            "https://drenix-blorf.pages.dev/": 1.0, "https://drenix-nextjs.pages.dev/": 0.5, "https://concat.pages.dev/": 1.0,
            "https://cat.pages.dev/": 0.0, "https://github.com": 0.0}
    given = spark.createDataFrame([(u, 1, "x") for u in urls] * 2, "url string, tokens int, word string")
    out = url_features_v2(given, dims=Dims.from_tables(words=words))
    assert out.columns[:3] == given.columns and out.count() == 2 * len(urls)
    got = {r.url: r.subdomain_nonword_ratio for r in out.collect()}
    assert got == urls
    listed = url_features_v2(given, dims=Dims(words=["smart", "home", "portfolio", "next", "cat"])).collect()
    assert sorted(map(tuple, listed)) == sorted(map(tuple, out.collect()))


def test_files_with_wildcards_are_refused(tmp_path):
    (tmp_path / "rules").write_text("co.uk\n*.ck\n")
    with pytest.raises(ValueError):
        Dims.from_files(suffixes=str(tmp_path / "rules"))


def test_crowded_scores_are_spread(spark):
    rng = random.Random(3)
    rows = [(i, rng.random() if i % 100 == 0 else 0.999 + rng.random() / 1000, rng.randint(0, 1)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, p double, y int")
    borders = R.quantile_borders(df, "p", 64)
    sizes = [r["count"] for r in df.crossJoin(borders).groupBy(R.border_bucket("p", F.col("borders")).alias("b")).count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * len(rows) / 64
    ordered = sorted(p for _, p, _ in rows)
    assert R.upper_median(df, "p").first().value == ordered[len(ordered) // 2]
    pos, neg = [p for _, p, y in rows if y], [p for _, p, y in rows if not y]
    rank = {p: k for k, p in enumerate(ordered)}
    want = (sum(rank[p] for p in pos) - len(pos) * (len(pos) - 1) / 2) / (len(pos) * len(neg))
    assert abs(M.roc_auc(df).first().auc - want) < 1e-9
    assert [r.pos for r in R.ordinal(spark.range(-5, 4000, 7).withColumnRenamed("id", "k"), "k").orderBy("k").collect()] == list(range(573))


@pytest.mark.parametrize("values", [[], [None, None], [1.0], [2.0] * 50, [float(i) for i in range(3000)]])
def test_border_buckets_keep_the_order(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = sorted((r.v, r.b) for r in df.filter("v is not null").crossJoin(R.quantile_borders(df, "v", 1024)).select(
        "v", R.border_bucket("v", F.col("borders")).alias("b")).collect())
    assert [b for _, b in got] == sorted(b for _, b in got)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    make = lambda rows: spark.createDataFrame(rows, "id long, text string, turn int")
    with pytest.raises(ValueError):
        VT.read_version(spark, path)
    assert VT.commit(make([(i, "a", 0) for i in range(200)] + [(None, "none", 0)]), path, ["id"], buckets=16) == 1
    assert VT.commit(make([(3, "late", 2), (3, "early", 1), (500, "new", 1)]), path, ["id"], "turn", stream="s", batch=0) == 2
    want = {i: "a" for i in range(200)} | {3: "late", 500: "new", None: "none"}
    assert {r.id: r.text for r in VT.read_version(spark, path).collect()} == want
    assert VT.read_version(spark, path).count() == len(want)
    first, second = VT.manifest(spark, path).orderBy("version").collect()
    changed = {b for b in second.holds if second.holds[b] != first.holds.get(b)}
    assert 1 <= len(changed) <= 2                                     # other buckets are neither read nor written
    assert VT.commit(make([(3, "again", 9)]), path, ["id"], "turn", stream="s", batch=0) == 2       # delivered again
    assert {r.id: r.text for r in VT.read_version(spark, path).collect()} == want
    assert {r.text for r in VT.read_version(spark, path, 1).collect()} == {"a", "none"}
    assert VT.commit(make([(None, "other", 1)]), path, ["id"]) == 3
    assert [r.text for r in VT.read_version(spark, path).filter("id is null").collect()] == ["other"]
    assert VT.commit(make([]), path, ["id"]) == 4


def test_a_failed_commit_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "table")
    VT.commit(spark.createDataFrame([(1, "a")], "id long, text string"), path, ["id"], buckets=4)
    broken = spark.createDataFrame([(1, "b")], "id long, text string").withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        VT.commit(broken, path, ["id"])
    assert _rows(VT.read_version(spark, path)) == [(1, "a")]
    VT.commit(spark.createDataFrame([(1, "c")], "id long, text string"), path, ["id"])
    assert _rows(VT.read_version(spark, path)) == [(1, "c")]


def test_upsert_stream(spark, tmp_path):
    source, path, log = (str(tmp_path / x) for x in ("in", "table", "log"))
    write = lambda rows: spark.createDataFrame(rows, "id long, text string, turn int").coalesce(1).write.mode("append").json(source)

    def run():
        rows = spark.readStream.schema("id long, text string, turn int").json(source)
        query = VT.upsert_stream(rows, path, ["id"], "turn", "s", 4).option("checkpointLocation", log).trigger(availableNow=True).start()
        query.awaitTermination()
    write([(1, "a", 1), (2, "a", 1)])
    run()
    write([(2, "b", 2), (3, "b", 1)])
    run()
    run()
    assert _rows(VT.read_version(spark, path).select("id", "text")) == [(1, "a"), (2, "b"), (3, "b")]
    assert [r.batch for r in VT.manifest(spark, path).orderBy("version").collect()] == [0, 1]


def test_punycode_labels(spark):
    words = ["bücher", "аррӏе", "faß", "παράδειγμα", "日本語", "a" * 20 + "é", "x-y-ö", "🙂ok", "ü" * 30, "ひらがな-test", "é" * 3 + "z" * 30]
    labels = ["xn--" + w.encode("punycode").decode() for w in words]
    bad = ["xn--a", "xn--!!", "xn--99999999", "xn--é", "xn--zzzzzzzzzzzzzzzzzz"]

    def plain(label):
        try:
            return label[4:].encode("ascii").decode("punycode")
        except (UnicodeError, ValueError):
            return None
    got = {r.l: r.d for r in frame(spark, labels + bad, "l").select("l", H.decode_label("l").alias("d")).collect()}
    assert got == {x: plain(x) for x in labels + bad}
    hosts = frame(spark, ["www.xn--bcher-kva.de", "xn--bcher-kva.xn--99999999", "plain.de", None], "h")
    assert [r[0] for r in hosts.select(H.decode_punycode("h")).collect()] == ["www.bücher.de", "bücher.xn--99999999", "plain.de", None]
    assert [r[0] for r in hosts.select(H.decode_punycode("h", False)).collect()][1] == "xn--bcher-kva.xn--99999999"


def test_public_ipv6(spark):
    rng = random.Random(1)
    ips = ["::1", "::", "fe80::1", "fe80::1%eth0", "fc00::1", "ff02::1", "2001:db8::1", "2002::1", "64:ff9b::1", "1:2:3", "12345::", "::1::", "2001:1::1",
           "2001:1::3", "2001:3::1", "2001:4:112::1", "2001:4:113::1", "2001:20::1", "2001:3f::1", "2001:40::5", "2001:200::1", "2600::1", ":1", "1:",
           "2600:1:2:3:4:5:1.2.3.4", "::ffff:10.0.0.1", "a.b:c", "fec0::1", "::g"]
    ips += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(200)]
    ips += [str(ipaddress.IPv6Address((0x20010000 << 96) | rng.getrandbits(rng.choice([1, 64, 122])))) for _ in range(200)]

    def public(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return False
        return not any((ip.is_private, ip.is_link_local, ip.is_reserved, ip.is_multicast))
    got = {r.i: r.p for r in frame(spark, ips, "i").select("i", H.is_public_ip("i").alias("p")).collect()}
    assert got == {i: public(i) for i in ips}


def test_url_joining(spark):
    bases = ["https://a.org/b/c/d?q=1#f", "http://a.org", "https://u:p@a.org:81/x/", "https://[::1]/p"]
    refs = ["next.html", "/top", "//other.org/z", "?only=1", "#frag", "../up", "../../../far", "./same/", "a/./b/../c?x=/../y", "..", ".", "",
            "https://c.net/../k", "mailto:x@y.z", "g;x=1/../y", None]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "base string, ref string")
    for row in df.select("base", "ref", U.join_url("base", "ref").alias("got")).collect():
        assert row.got == urljoin(row.base, row.ref or ""), (row.base, row.ref)


def test_redirects(spark):
    edges = [("https://a.org/1", 302, "2", True), ("https://a.org/2", 301, "//b.org/3?x", True), ("https://b.org/3?x", 200, None, True),
             ("https://c.org/", 302, "https://[::1]/in", True), ("https://[::1]/in", 302, "https://b.org/3?x", None),
             ("https://l.org/1", 302, "/2", True), ("https://l.org/2", 302, "/1", True), ("https://l.org/in", 302, "1", True),
             ("https://s.org/", 302, "https://s.org/", True), ("https://p.org/", 302, "https://b.org/3?x", False), ("https://p.org/", 302, "https://zz/", False)]
    chain = [(f"https://long.org/{k}", 302, str(k + 1), True) for k in range(300)]
    df = spark.createDataFrame(edges + chain, "url string, status int, location string, public boolean")
    got = {r.url: (r.final_url, r.hops, r.cycle) for r in J.redirect_ends(df).collect()}
    assert len(got) == 310
    assert got["https://a.org/1"] == ("https://b.org/3?x", 2, False) and got["https://b.org/3?x"] == ("https://b.org/3?x", 0, False)
    assert got["https://c.org/"] == ("https://[::1]/in", 1, False) and got["https://p.org/"] == ("https://p.org/", 0, False)
    assert all(got[f"https://l.org/{x}"] == (None, None, True) for x in ("1", "2", "in")) and got["https://s.org/"][1] == 0
    assert all(got[f"https://long.org/{k}"] == ("https://long.org/300", 300 - k, False) for k in range(300))
    out = {r.url: r for r in J.resolve_redirects(df.select("url").distinct(), df.filter("location <> 'https://zz/' or location is null")).collect()}
    assert out["https://a.org/1"].redirect_chain == ["https://a.org/2", "https://b.org/3?x"]
    assert out["https://c.org/"].blocked and not out["https://a.org/1"].blocked
    assert out["https://long.org/0"].truncated and not out["https://long.org/296"].truncated


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_csv_records_over_split_borders(spark, tmp_path, ending):
    rng = random.Random(7)
    parts = ["", "plain", "two\nlines", 'say "hi", twice', "\n\n", '"', ",", "a\r\nb", "x" * 90, "ends\n", '"\n"', " padded "]
    rows = [(str(i), rng.choice(parts) + rng.choice(parts), rng.choice(["0", "1"])) for i in range(300)]
    want = []
    for name in ("one", "two"):
        with open(tmp_path / f"{name}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator=ending)
            writer.writerow(["id", "text", "Label"])
            for n, row in enumerate(rows):
                writer.writerow(row)
                if n % 50 == 0:
                    out.write(ending)       # a blank line
        want += [(i, t or None, y) for i, t, y in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "211")
    try:
        df = RD.read_csv_records(spark, str(tmp_path / "*.csv"))
        got = [tuple(r) for r in df.collect()]
        mails = RD.read_mail_corpora(spark, [str(tmp_path / "one.csv")]).collect()
        assert spark.read.text(str(tmp_path / "*.csv")).rdd.getNumPartitions() > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert df.columns == ["id", "text", "Label"]
    key = lambda r: (r[0], r[1] or "", r[2])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sorted((r.text or "", r.label) for r in mails) == sorted((t, int(y)) for _, t, y in rows)
    assert RD.read_mail_corpora(spark, [str(tmp_path / "one.csv")], whole_files=True).count() == 300


def test_csv_records_short_long_and_none(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1\n1,2,3\n"",""\n,\n')
    rows = RD.read_csv_records(spark, str(tmp_path / "a.csv")).collect()
    assert sorted((r.x or "-", r.y or "-") for r in rows) == [("-", "-"), ("-", "-"), ("1", "-"), ("1", "2")]
    (tmp_path / "b.csv").write_text("x,y\n")
    assert RD.read_csv_records(spark, str(tmp_path / "b.csv")).count() == 0
