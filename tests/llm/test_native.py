import re
from collections import Counter

from docket.llm import license_scan, url_filter
from docket.llm.queries import CHECKS, QUERIES

from .helpers import documents, odd_rows, prose

PAGES = "page_id long, url string, html string, host string, score double, kind int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 0.0, 1) for i, u, h in rows], PAGES)


def test_url_parts_and_rules(spark):
    urls = [
        "HTTP://WWW.Example.COM/en/x?y", "http://example.com/en/", "http://m.example.com/de/a#b", "x://a.net/es/1", "x://a.net/de/1", "x://net/fr/",
        "http://com", "http://com?x/", "http://notcom/", None, "", "no scheme/", "a://b://c/d", "http://ÄB.org/p\nq", "http://a.net/es", "x://subnet/es/",
    ]
    got = {r.page_id: r for r in url_filter.url_verdicts(pages(spark, [(i, u, None) for i, u in enumerate(urls)])).collect()}
    assert [got[i].rule for i in range(len(urls))] == [
        "www.example.com/en/", "example.com/en/", "com/", "net/es/", None, "net/fr/", None, None, None, None, None, None, None, None, None, None,
    ]
    assert (got[0].host, got[0].path) == ("www.example.com", "/en/x") and (got[2].host, got[2].path) == ("m.example.com", "/de/a")
    assert (got[12].host, got[12].path) == ("b:", "//c/d") and (got[13].host, got[13].path) == ("Äb.org", "/p\nq")
    assert [(got[i].host, got[i].path) for i in (9, 10, 11)] == [("", "")] * 3
    assert all(r.verdict in ("allow", "block") for r in got.values()) and got[1].verdict == "block" and got[0].verdict == "allow"
    assert url_filter.url_verdicts(pages(spark, [])).collect() == []


def brute_scores(rows, keep=url_filter.KEEP):
    def host(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)", u or "")
        return m[1].lower() if m else ""

    def ruled(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        fits = [r for r in url_filter.RULES if m and (m[1] == r[0] or m[1].endswith("." + r[0])) and m[2].startswith(r[1])]
        return max(fits, key=lambda r: len(r[0] + r[1]))[2] if fits else None

    seeds = {"allow": Counter(), "block": Counter()}
    edges = Counter()
    for _, u, h in rows:
        if host(u):
            if ruled(u):
                seeds[ruled(u)][host(u)] += 1
            for link in re.findall(r"""(?i)href\s*=\s*["']?([^"'\s>]+)""", h or ""):
                edges[host(u), host("http:" + link if link.startswith("//") else link) or host(u)] += 1
    hosts = {host(u) for _, u, _ in rows if host(u)} | {d for _, d in edges}
    out = []
    for kind, steps in (("allow", edges), ("block", Counter({(d, s): n for (s, d), n in edges.items()}))):
        total = sum(seeds[kind].values()) or 1
        seed = {h: seeds[kind][h] / total for h in hosts}
        leaving = {h: sum(n for (s, _), n in steps.items() if s == h) for h in hosts}
        score = dict(seed)
        for _ in range(200):
            lost = keep * sum(score[h] for h in hosts if not leaving[h])
            new = {h: (1 - keep + lost) * seed[h] for h in hosts}
            for (s, d), n in steps.items():
                new[d] += keep * score[s] * n / leaving[s]
            score = new
        out.append(score)
    return out


def test_trust_and_distrust_equal_brute_force(spark):
    link = lambda *hosts: "".join(f'<a HREF = "http://{h}/x">' for h in hosts)
    rows = [(i, "http://good.com/a", link("friend.org", "friend.org", "odd.org") + '<a href="/own">') for i in range(3)]
    rows += [(10, "http://friend.org/", link("good.com")), (11, "http://spam.org/", link("bad.net", "bad.net")), (12, "http://farm.org/", link("spam.org"))]
    rows += [(20 + i, "http://bad.net/es/1", '<a href=//pr.net/q>') for i in range(4)] + [(30, "http://alone.org/", None), (31, None, link("good.com"))]
    rows += [(40, "http://bad.net/en/1", None), (10, "http://friend.org/", link("good.com"))]
    got = {r.host: r for r in url_filter.host_scores(pages(spark, rows), url_filter.RULES).collect()}
    trust, distrust = brute_scores(rows)
    assert all(abs(r.trust - trust[h]) < 0.01 and abs(r.distrust - distrust[h]) < 0.01 for h, r in got.items())
    verdicts = {(r.page_id, r.host): r.verdict for r in url_filter.url_verdicts(pages(spark, rows)).collect()}
    assert verdicts[11, "spam.org"] == "block" and verdicts[10, "friend.org"] == "allow" and verdicts[30, "alone.org"] == "allow"


def test_scores_reach_the_end_of_a_long_chain(spark):
    link = lambda host: f'<a href="http://{host}/x">'
    hosts = ["bad.net", *(f"h{i}.org" for i in range(30))]
    rows = [(0, "http://bad.net/es/1", None)] + [(i, f"http://{hosts[i]}/", link(hosts[i - 1])) for i in range(1, 31)]
    got = {r.host: r for r in url_filter.host_scores(pages(spark, rows), url_filter.RULES).collect()}
    _, distrust = brute_scores(rows)
    total = sum(distrust.values())
    assert all(got[h].distrust > 0 and abs(got[h].distrust - distrust[h] / total) < 0.01 / len(rows) for h in hosts)


def brute_license(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [
        (i, label) for label, p in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()
    ]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def test_licenses(spark):
    mit = license_scan.NOTICES["mit"]
    inserted = mit.replace("free of", "really free of").replace("copy of", "copy ☃ of")
    texts = [
        "Licensed under CC BY-NC 4.0.", "ALL RIGHTS RESERVED all rights reserved. All rights, reserved", "GNU General Public License, version 3",
        f"x y {mit.title()} z", f"{prose(1, 50)} {inserted} {prose(2, 50)}", "permission is hereby granted", "cc", "by cc", "cc by cc by",
        "Licensed under the Apache License, Version 2.0.", "general public", "été cc by", "cc\x00by",
    ]
    rows = list(enumerate(texts, 100)) + odd_rows()
    got = license_scan.license_scan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    base = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)
    assert base == Counter((i, *brute_license(t)) for i, t in rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[103].labels == by_id[104].labels == "mit" and by_id[105].labels == "" and by_id[109].labels == "apache"
    assert by_id[103].score == 1 and 0.75 <= by_id[104].score < 1 and 0 < by_id[105].score < 0.75 and by_id[106].score == 0
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} for r in got)
    assert license_scan.license_scan(documents(spark, [])).collect() == []


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(CHECKS) <= set(QUERIES)
