"""URL rules and licence digests: against plain Python and their SQL, and on awkward tables."""

import random
import re
import textwrap

import duckdb
import pytest

pytest.importorskip("peptrellis.llm")
from peptrellis.llm import licences, urlrules  # noqa: E402

URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/x", "http://example.com/EN/x", "https://www.example.com/en/", "https://a.www.example.com/en/b?c=://d.net/es/", "https://x.net/es/1#y", "http://net/fr/",
    "http://notexample.com/en/", "http://com", "http://com/", "http://a.com?x=/en/", "ftp://spam-farm.example.org/q", "http://spam-farm.example.com/q", "http://hamspam.org/", "http://x.org/a/viagra", "http://x.org/viagranot", "a\nb://Q.net/fr/\nz",
]


def plain(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in urlrules.SITE_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    if best:
        return host, path, *best
    block = any(re.search(p, host + path) for p, _ in urlrules.block_patterns())
    return host, path, None, "block" if block else "allow"


def test_verdicts_equal_plain_python_and_sql(spark):
    pages = spark.createDataFrame([(i, u, "<p>", "x") for i, u in enumerate(URLS)] + [(4, URLS[4], "<p>", "x")], "page_id long, url string, html string, host string")
    rows = urlrules.judged(pages).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain(URLS[r.page_id]), URLS[r.page_id]
    with duckdb.connect() as c:
        c.execute("CREATE TABLE pages (page_id bigint, url varchar)")
        c.executemany("INSERT INTO pages VALUES (?, ?)", [(i, u) for i, u in enumerate(URLS)])
        for i, *got in c.sql(urlrules.SQL.strip()).fetchall():
            assert tuple(got) == plain(URLS[i])
    assert urlrules.judged(pages.limit(0)).collect() == []


def test_index_tokens_are_in_every_matching_url():
    for _, pattern, _, _, tokens in urlrules.default_rules():
        for url in URLS:
            host, path, *_ = plain(url)
            if re.search(pattern, host + path):
                assert set(tokens) <= set(re.split("[^a-z0-9]+", (host + path).lower()))


def test_only_rules_with_their_rarest_token_in_the_url_run(spark):
    rng = random.Random(6)
    some = [w for words in urlrules.UNWANTED.values() for w in words] + [w for pair in urlrules.UNWANTED_PAIRS for w in pair] + urlrules.AD_HOSTS + urlrules.PATH_SEGMENTS
    plain_words = ["www", "example", "blog", "en", "stone", "river", "net", "com", "org"]
    word = lambda: rng.choice(some if rng.random() < 0.3 else plain_words)
    join = lambda marks: "".join(rng.choice(marks) + word() for _ in range(rng.randrange(4)))
    urls = [f"https://{word()}{join('.-')}.{rng.choice(['com', 'net', 'org'])}/{word()}{join('/-._')}{rng.choice(['', '/', '?q=casino', '#poker'])}" for _ in range(1500)] + ["http://" + "a-" * 30_000 + "casino.org/x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0])], "page_id long, url string")
    rules = urlrules.default_rules()
    assert len(rules) > 200
    got = urlrules.judged(pages).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id or 0]), urls[r.page_id or 0]
    assert 100 < sum(r.rule is None and r.verdict == "block" for r in got) < 1400
    # The index excludes nearly all of the rules that each url could run.
    tried = urlrules.fetched(pages).where("token is not null").count()
    assert tried < 0.05 * len(urls) * len(rules)
    # Two rules of one priority: the verdict, then the rule, that sorts last.
    tie = [("a/", "^a/", "allow", 3, ["a"]), ("b", "^a/", "block", 3, ["a"]), ("c", "^a/", "block", 3, ["a"])]
    one = urlrules.judged(spark.createDataFrame([(1, "x://a/")], "page_id long, url string"), tie).collect()
    assert [(r.rule, r.verdict) for r in one] == [("c", "block")]


def test_licences_by_canonical_form(spark):
    mit = licences.KNOWN[0][1]
    docs = [
        (1, mit), (2, "mit LICENCE\n\nCopyright (c) 2020 Somebody\n" + mit.split("\n", 1)[1].replace("sublicense", "sub-licence").upper()), (3, mit + " and more"), (4, None), (5, ""),
        (6, "some prose.\n  released UNDER the MIT Licence\nmore"), (7, "Licensed under CC BY NC 4.0!"), (8, "licen\nreleased"), (1, mit),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, license string")
    got = sorted((r.doc_id, r.scope, r.line_no, r.license) for r in licences.scan(df).collect())
    assert got == [(1, "text", 0, "MIT"), (1, "text", 0, "MIT"), (2, "text", 0, "MIT"), (6, "line", 2, "MIT"), (7, "line", 1, "CC-BY-NC-4.0"), (7, "text", 0, "CC-BY-NC-4.0")]
    assert licences.scan(df.limit(0)).collect() == []


def by_hand(docs, texts):
    """Every whole text and every line, made canonical in plain Python."""

    def canonical(t):
        t = re.sub(licences.COPYRIGHT_LINE, "\n", "".join(c.lower() if "A" <= c <= "Z" else c for c in t).replace("\n", "\n\n"))
        t = " " + re.sub("[^a-z0-9]+", " ", t).strip(" ") + " "
        for one, other in licences.SPELLINGS:
            t = t.replace(one, other)
        return t.strip(" ")

    known = {}
    for name, t in texts:
        known[canonical(t)] = min(name, known.get(canonical(t), name))
    out = []
    for i, t in docs:
        for k, unit in enumerate([t, *t.split("\n")] if t is not None else []):
            if canonical(unit) in known:
                out.append((i, "line" if k else "text", k, known[canonical(unit)]))
    return out


def test_licences_equal_looking_every_unit_up(spark):
    isc, bsd, mit = (next(t for n, t in licences.KNOWN if n == name) for name in ("ISC", "BSD-3-Clause", "MIT"))
    wrapped = lambda t, n: "\n".join(line for p in t.split("\n") for line in textwrap.wrap(p, n) or [""])
    head = "Copyright (c) 1999-2020, The Foo Authors\nCopyright Acme, Inc.\nAll rights reserved.\n\n"
    own = [("PD", "Dedicated to the public domain."), ("X", "Use it as you like")]
    docs = [
        (1, wrapped(isc, 72)), (2, wrapped(bsd, 79).replace("\n1.", "\n * 1.")), (3, "# " + wrapped(mit, 60).replace("\n", "\n# ")), (4, head + wrapped(isc, 70)), (5, head), (6, None), (7, ""),
        (None, "x\nDedicated to the PUBLIC domain\ny"), (9, "use it, as you like!"), (10, "prose " * 200_000 + "\nLicenced under the MIT licence"), (11, "Copyright 2020 x"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for texts in (licences.KNOWN, own, [*own, ("none", "licence")]):
        got = sorted(((r.doc_id, r.scope, r.line_no, r.license) for r in licences.scan(df, texts).collect()), key=str)
        assert got == sorted(by_hand(docs, texts), key=str)
    found = {r.doc_id: r.license for r in licences.scan(df).collect()}
    assert found == {1: "ISC", 2: "BSD-3-Clause", 3: "MIT", 4: "ISC", 10: "MIT"}
    assert licences.hints([("none", "licence")]) is None


def test_known_licences_have_different_forms():
    assert len({t for _, t in licences.KNOWN}) == len(licences.KNOWN) >= 30
