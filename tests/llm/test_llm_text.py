"""Fingerprints, licenses, quality rules, chat formatting and URL templates."""

import hashlib
import random
import re
import textwrap

import pytest
from compare import compare, oracle
from pyspark.sql import functions as F

from accountscope.llm import chat, fingerprints, licenses, quality, queries, urls


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# ---------------------------------------------------------------- fingerprints


def plain_merkle(text):
    """The tree by loops: fingerprint string and set of leaf codes."""
    sections, codes = [[]], []
    for k, p in enumerate(text.split("\n")):
        leaves = [sha(x) for x in re.findall(fingerprints.LEAF, p)]
        digest = sha("".join(leaves))
        if k and (not leaves or digest[0] in "01"):
            sections.append([])
        short = [x[: fingerprints.CODE] for x in leaves]
        codes += short
        sections[-1].append((digest, "".join(short)))
    full = [",".join(f"{d}.{c}" for d, c in s) for s in sections]
    digests = [sha(x) for x in full]
    tree = "/".join(f"{d[:16]}=" + ",".join(f"{h[:8]}.{c}" for h, c in s) for d, s in zip(digests, sections))
    return f"{sha(''.join(digests))}:{tree}", set(codes)


def plain_likeness(a, b):
    (fa, ca), (fb, cb) = a, b
    if fa.split(":")[0] == fb.split(":")[0]:
        return 1.0
    return min(2.0 * len(ca & cb) / (len(ca) + len(cb)), 0.999999) if ca or cb else 0.0


def expected_edits(rows):
    """(doc_id, edited sha, fingerprints, likenesses) of unique ids, by loops."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, e, n = plain_merkle(t), plain_merkle(edited), plain_merkle(nxt)
        out[i] = (len(t), sha(edited), a[0], e[0], plain_likeness(a, e), plain_likeness(a, n))
    return out


def test_fingerprints_equal_brute_force(spark, docs):
    got = {r[0]: tuple(r[1:]) for r in fingerprints.edit_report(docs).collect()}
    want = expected_edits([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got == want


def test_fingerprints_without_ids_have_a_next_text_too(spark, docs):
    """Rows without an id fill several ranges; together they form one cycle behind those with one."""
    some = docs.select(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("doc_id"), F.concat("text", F.lit(" "), "doc_id").alias("text"))
    pairs = [(r.id, r.text, r.next_text, r.own) for r in fingerprints.with_next(some).withColumn("own", F.xxhash64("text")).collect()]
    order = sorted(pairs, key=lambda r: (r[0] is None, -(r[0] or 0), r[3]))
    assert len(order) == some.count()
    assert [r[2] for r in order] == [r[1] for r in order[1:] + order[:1]]


def test_fingerprints_of_messy_rows(messy, nothing):
    rows = fingerprints.edit_report(messy).collect()
    assert len(rows) == messy.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].n_chars == 0 and by[2][0].fingerprint == by[3][0].fingerprint == plain_merkle("")[0]
    assert by[8][0].fingerprint == by[-9][0].fingerprint  # equal texts, whatever their ids
    assert len({r.fingerprint for r in by[5]}) == 2
    assert len(by[None]) == 2
    assert fingerprints.edit_report(nothing).collect() == []


def test_one_document_is_its_own_successor(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")
    row = fingerprints.edit_report(one).first()
    assert row.edited_sha256 == sha("abcabc") and row.near_next == 1.0


def test_changed_sections_locate_the_edit(spark):
    lines = [f"Paragraph number {k} says something of its own." for k in range(60)]
    other = list(lines)
    other[40] = "This paragraph was rewritten."
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    fp = df.select(*[fingerprints.fingerprint(fingerprints.merkle(F.col(c))).alias(c) for c in "ab"])
    changed = fp.select(fingerprints.changed_sections(F.col("a"), F.col("b"))).first()[0]
    assert 1 <= len(changed) <= 2
    assert sha("".join(sha(x) for x in re.findall(fingerprints.LEAF, lines[40])))[:8] in "".join(changed)


# ---------------------------------------------------------------- licenses


def plain_scan(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    ws = [w for w in re.split(licenses.WORD_GAPS, low) if w]
    places = []
    for i in range(len(ws)):
        for phrase, label in licenses.PHRASES.items():
            if ws[i:i + len(phrase.split())] == phrase.split():
                places.append((i, label))
    labels, score = {x for _, x in places}, 1.0 if places else 0.0
    lines = [{w for w in re.split(licenses.WORD_GAPS, block) if w} for block in low.split("\n")]
    for label, template in licenses.TEMPLATES:
        need, run = set(licenses.template_words(template)), len(licenses.words_of(template))
        for have in lines + [set(ws[i:i + run]) for i in range(len(ws))]:
            share = len(have & need) / len(need)
            if share >= licenses.THRESHOLD:
                labels.add(label)
                score = max(score, share)
    starts = [s for s, _ in places]
    return (len(ws), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score)


LICENSED = [
    "Some code.\n" + licenses.TEMPLATES[1][1] + ".\nmore",
    "mit license MIT-LICENSE; the Apache license. General Public License mit",
    "redistribution and use in source or binary forms, with or without modification, are permitted provided the following conditions are met",
    "public license general", "licensed under cc by\n4.0", "İMIT license K license",
    "licensed\n\nunder cc 1 2 3 4 5 6 7 8 by 4.0", "of the and to in by " * 40 + "licensed under\ncc by the 4.0",
]


@pytest.mark.parametrize("width", [24, 72])
def test_wrapped_notices_keep_their_labels(spark, width):
    notices = [(k, label, t) for k, (label, t) in enumerate(licenses.TEMPLATES)]
    rows = [(k, "Some words of the program before. " + "\n# ".join(textwrap.wrap("It says: " + t + " And more follows it.", width))) for k, _, t in notices]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k, label, _ in notices:
        assert label in found[k].labels.split(",") and found[k].score == 1.0
    assert {k: plain_scan(t)[-2:] for k, t in rows} == {k: (r.labels, r.score) for k, r in found.items()}


def test_licenses_equal_brute_force(spark, docs, messy):
    more = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(LICENSED)], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").unionByName(more).unionByName(messy.select("doc_id", "text"))
    got = sorted((tuple(r) for r in licenses.scan(every).collect()), key=str)
    want = sorted(((r.doc_id, *plain_scan(r.text or "")) for r in every.collect()), key=str)
    assert got == want
    assert any(r[6] == "bsd" for r in got) and any(r[6] == "mit" and r[2] == 0 for r in got)


def test_licenses_of_nothing_and_with_clashing_columns(messy, nothing):
    assert licenses.scan(nothing).count() == 0
    assert licenses.scan(messy).count() == messy.count()


# ---------------------------------------------------------------- quality rules


def plain_facts(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    at = {}
    for i in range(len(ws) - 2):
        at.setdefault(tuple(ws[i:i + 3]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts_equal_brute_force(spark, docs, messy):
    repeats = ["a b c a b c", "a a a a", "a b", "x y z q x y z r x y z", "l\nl\n \nl\nm", "# | <b> $% &"]
    more = spark.createDataFrame([(20_000 + k, t) for k, t in enumerate(repeats)], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").unionByName(more).unionByName(messy.select("doc_id", "text"))
    got = sorted((tuple(r)[:7] for r in quality.judge(every, []).collect()), key=str)
    want = []
    for r in every.collect():
        f = plain_facts(r.text or "")
        want.append((r.doc_id, *f, f[0] < 50 or 100 * f[4] > 50 * f[0]))
    assert got == sorted(want, key=str)


def quality_sample(spark, n=2_000, noise=0.0):
    rng = random.Random(5)
    names = list(quality.MEASURES)
    rows = []
    for i in range(n):
        v = [rng.random() for _ in names]
        bad = v[2] > 0.7 or (v[5] > 0.6 and v[1] <= 0.4)
        rows.append((i, v, bad != (rng.random() < noise), False))
    return spark.createDataFrame(rows, "id bigint, values array<double>, bad boolean, failed boolean")


def test_rules_find_the_conjunctions(spark):
    sample = quality_sample(spark)
    rules = quality.learn(sample)
    assert rules[0][0].measure == "symbol_share" and rules[0][0].above and abs(rules[0][0].cut - 0.7) < 0.05
    assert any({c.measure for c in r} == {"capital_share", "word_length"} for r in rules)
    fired = sample.select("bad", quality.rule_number(rules, F.col("values")).isNotNull().alias("hit"))
    right = fired.where("bad = hit").count() / fired.count()
    assert right > 0.95


def test_rules_hold_on_unseen_rows_and_noise(spark):
    rules = quality.learn(quality_sample(spark, 1_500, noise=0.02), quality.CoverConfig(precision=0.85))
    unseen = quality_sample(spark, 3_000).where("id >= 1500")
    fired = unseen.select("bad", quality.rule_number(rules, F.col("values")).isNotNull().alias("hit"))
    assert fired.where("bad = hit").count() / fired.count() > 0.9


def test_rules_without_evidence(spark, docs, messy, nothing):
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id bigint, quality int")
    assert quality.learn(quality.labelled_sample(messy, labels, quality.CoverConfig())) == []
    assert quality.learn(quality.labelled_sample(nothing, labels.where("false"), quality.CoverConfig())) == []
    kept = quality.keep_good(messy, [])
    assert kept.columns == messy.columns and [r.doc_id for r in kept.collect()] == []
    assert quality.judge(nothing, []).count() == 0
    longer = messy.withColumn("text", F.when(F.col("doc_id") == 1, F.lit(" ".join(f"w{i}" for i in range(80)))).otherwise(F.col("text")))
    assert [r.doc_id for r in quality.keep_good(longer, []).collect()] == [1]


def test_clean_documents_stay(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rules = quality.learn(quality.labelled_sample(docs, labels, quality.CoverConfig()))
    judged = quality.judge(docs, rules).join(labels, "doc_id").where("quality = 1 AND NOT base_failed")
    assert judged.where("NOT kept").count() <= 0.02 * judged.count()


# ---------------------------------------------------------------- chat formatting

NASTY = ["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<\\\\|x", "<|", "<", "|>", "a<|im_end|", "<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n",
         "", "\n", "%0A%25", "\\", "<|im_start|>assistant\n", "plain", "<\\\\\\|", "ends with <", "$1 \\1"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    convs = {c: [(rng.choice(["user", "assistant", "we\nird%", "<|im_start|>", ""]), rng.choice(NASTY) + rng.choice(NASTY)) for _ in range(rng.randint(1, 6))] for c in range(60)}
    df = spark.createDataFrame([(c, k, r, t) for c, ts in convs.items() for k, (r, t) in enumerate(ts)], "conv_id bigint, turn bigint, role string, text string")
    out = chat.conversations(df).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    for r in out:
        assert [(t.role, t.text) for t in r.turns] == convs[r.conv_id]
        assert "".join(s.value for s in r.segments) == r.formatted
        body = [s.value for s in r.segments][1::3]
        assert not any("<|im_start|>" in b or "<|im_end|>" in b for b in body)
    for r in chat.digest(chat.conversations(df)).collect():
        learned = "".join(t for role, t in convs[r.conv_id] if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))
        assert r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in convs[r.conv_id]))


def test_chat_plain_turns_are_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a <| b")], "conv_id bigint, turn bigint, role string, text string")
    assert chat.conversations(df).first().formatted == "<|im_start|>user\na <| b<|im_end|>\n"


def test_chat_messy_turns(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "x"), (1, 2, "user", "b"), (1, 2, "user", "b"), (1, 1, "assistant", ""), (2, 0, "assistant", "long " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("segments", F.lit(1)).withColumn("conv", F.lit(2))
    got = {r.conv_id: r for r in chat.digest(chat.conversations(df)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {None: 2, 1: 3, 2: 1}
    assert got[1].loss_chars == 0 and got[1].loss_sha256 == sha("") and got[2].loss_chars == 1_000_000
    assert chat.digest(chat.conversations(df.where("false"))).count() == 0


def test_parser_refuses_what_is_not_in_the_grammar(spark):
    bad = ["", "x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>", "x<|im_start|>user\nhi<|im_end|>\n", "<|im_start|>user\na<|im_end|>b<|im_end|>\n"]
    df = spark.createDataFrame([(b,) for b in bad], "f string")
    assert [r[0] for r in df.select(chat.parse(F.col("f"))).collect() if r[0]] == []


# ---------------------------------------------------------------- URL templates


def plain_judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


ODD_URLS = [None, "", "no scheme", "http://", "http://ORG/", "http://a.org", "https://Example.org/es/x?y#z", "http://x.example.org/en/12", "a://b://c/d",
            "http://xorg/", "http://x.com/fr/", "http://x.com/fr", "//x.com/fr/", "http://h.net?q=/a/b", "http://É.COM/de/1", "x\n://y.com/fr/\n1"]


def test_urls_equal_plain_rules(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(10_000 + k, u) for k, u in enumerate(ODD_URLS)] + [(None, "http://q.net/a"), (None, "http://q.net/a")], "page_id bigint, url string")
    every = pages.unionByName(odd).withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in urls.judge(every).collect()), key=str)
    assert got == sorted(((r.page_id, *plain_judge(r.url)) for r in every.collect()), key=str)
    assert {r.verdict for r in urls.judge(every).collect()} <= {"allow", "block"}
    assert urls.judge(every.where("false")).count() == 0


def plain_purities(rows, cfg=urls.TreeConfig()):
    """(host, path) -> smoothed purity, for rows of (host, path, verdict of a rule): recursion over each scope's tree."""
    def shape(path):
        parts = path[1:] if path.startswith("/") else path
        out = [re.sub(r"\*(?:[-_.,:]?\*)+", "*", re.sub(r"[0-9a-fA-F]{16,}|[0-9]+", "*", p)) for p in parts.split("/")]
        return tuple(out[:cfg.depth] + ["**"]) if len(out) > cfg.depth else tuple(out)

    def domain(host):
        return "1:" + ".".join(re.sub(":[0-9]*$", "", host).split(".")[-2:])

    scopes = [{}, {}, {}]
    for host, path, verdict in rows:
        for scope, name in enumerate(("0:", domain(host), "2:" + host)):
            n = scopes[scope].setdefault(name, {}).setdefault(shape(path), [0, 0, 0])
            for i, hit in enumerate((1, verdict == "block", verdict == "allow")):
                n[i] += hit
    bad, good = (sum(v[i] for v in scopes[0]["0:"].values()) for i in (1, 2))
    base = (bad + 1) / (bad + good + 2)
    names, outer = {}, {}

    def add(patterns, i):
        return sum(v[i] for v in patterns.values())

    def visit(name, at, level, patterns, towards, labelled, up, purity):
        """Name the children of a node, merge them, and go on below each."""
        kids = {}
        for segs, v in patterns.items():
            if len(segs) > level:
                kids.setdefault(segs[level], {})[segs] = v
        whole = sum(add(k, 0) for k in kids.values())
        nodes = {}
        for seg, own in kids.items():
            small = len(kids) > cfg.branches and add(own, 0) < cfg.min_share * whole and seg != "**"
            nodes.setdefault(at + "/" + ("*" if small else seg), {}).update(own)
        known = sorted((add(p, 1) / (add(p, 1) + add(p, 2)), node) for node, p in nodes.items() if add(p, 1) + add(p, 2))
        groups = [[node] for node in nodes if not add(nodes[node], 1) + add(nodes[node], 2)]
        for k, (rate, node) in enumerate(known):
            b, n = add(nodes[node], 1), add(nodes[node], 1) + add(nodes[node], 2)
            if k:
                was = nodes[known[k - 1][1]]
                b0, n0 = add(was, 1), add(was, 1) + add(was, 2)
                pooled = (b + b0 + 1) / (n + n0 + 2)
                apart = b / n - b0 / n0 > cfg.z * (pooled * (1 - pooled) * (1 / n + 1 / n0)) ** 0.5
            if not k or apart:
                groups.append([])
            groups[-1].append(node)
        for group in groups:
            b, g = (sum(add(nodes[node], i) for node in group) for i in (1, 2))
            goal = towards
            if up is not None:
                pairs = [(v[0], outer[up, names[up, segs][level]]) for node in group for segs, v in nodes[node].items()]
                wide = sum(n * x for n, x in pairs) / sum(n for n, _ in pairs)
                goal = (wide + towards) / 2 if labelled else wide
            for node in group:
                purity[name, node] = (b + cfg.prior * goal) / (b + g + cfg.prior)
                for segs in nodes[node]:
                    names.setdefault((name, segs), []).append(node)
                visit(name, node, level + 1, nodes[node], purity[name, node], add(nodes[node], 1) + add(nodes[node], 2), up, purity)

    for scope in range(3):
        purity = {}
        for name, patterns in scopes[scope].items():
            b, g = add(patterns, 1), add(patterns, 2)
            up = None if scope == 0 else "0:" if scope == 1 else domain(name[2:])
            purity[name, ""] = (b + cfg.prior * (base if up is None else outer[up, ""])) / (b + g + cfg.prior)
            visit(name, "", 0, patterns, purity[name, ""], b + g, up, purity)
        outer.update(purity)
    return {(h, p): outer["2:" + h, names["2:" + h, shape(p)][-1]] for h, p, _ in rows}


def test_url_verdicts_equal_brute_force(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    crowded = [(20_000 + k, f"http://w{k % 3}.many.org:80/{'es' if k % 5 else 'x' + chr(97 + k % 26) + 'yz'[k % 2]}/{k}") for k in range(150)]
    every = pages.unionByName(spark.createDataFrame(crowded, "page_id bigint, url string"))
    rules = [*urls.RULES, ("block", "many.org:80", "/es/1"), ("allow", "many.org:80", "/x")]
    out = urls.judge(every, rules=rules).collect()
    want = plain_purities([(r.host, r.path, r.verdict if r.rule else None) for r in out])
    for r in out:
        assert r.purity == pytest.approx(want[r.host, r.path], abs=1e-9), (r.host, r.path)
        assert r.rule or r.verdict == ("block" if r.purity >= urls.TreeConfig().reject else "allow")


def test_url_templates_speak_for_hosts_without_labels(spark):
    rows = [(f"http://{h}.example.org/{s}/{i}", None) for h in "abc" for s in ("es", "fr") for i in range(30)]
    rows += [(f"http://other.net/{s}/{i}", v) for s, v in (("es", "block"), ("fr", "allow"), ("new", "allow")) for i in range(3)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id bigint, url string")
    out = {r.page_id: r for r in urls.judge(pages, rules=[("allow", "org", "/"), ("block", "example.org", "/es/")]).collect()}
    assert {out[i].verdict for i, (u, v) in enumerate(rows) if v == "block"} == {"block"}
    assert {out[i].verdict for i, (u, v) in enumerate(rows) if v == "allow"} == {"allow"}
    assert all(out[i].rule is None for i, (_, v) in enumerate(rows) if v)
    assert len({round(out[i].purity, 6) for i, (_, v) in enumerate(rows) if v}) == 3


def test_url_templates_learn_from_labels(spark):
    rows, labels = [], []
    for k in range(400):
        for section, bad in (("spam", 1), ("news", 0), ("blog", 0)):
            i = len(rows)
            rows.append((i, f"http://h.net/{section}/item-{k}/page{k}.html"))
            if k % 2:
                labels.append((i, bool(bad)))
    for k in range(60):  # many children without any label: one variable node
        rows.append((len(rows), f"http://h.net/{chr(97 + k % 26)}x{'yz' * (k // 26)}/a"))
    pages, known = spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, bad boolean")
    out = {r.page_id: r for r in urls.judge(pages, rules=[], labels=known).collect()}
    for i, (_, url) in enumerate(rows):
        assert out[i].verdict == ("block" if "/spam/" in url else "allow"), url
    assert out[0].template == "/spam/item-*/page*.html"
    assert out[1200].template == "/*/a"
    assert out[1].purity == pytest.approx(out[2].purity, abs=0.02)


# ---------------------------------------------------------------- SQL counterparts


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, folder, name):
    assert compare(spark, oracle(folder), folder, name) == ""


def test_text_without_turns_is_an_error(spark):
    broken = spark.createDataFrame([(1, "no turn at all", [("no turn at all", False)])], "conv_id bigint, formatted string, segments array<struct<value:string,loss:boolean>>")
    with pytest.raises(Exception, match="not a formatted conversation: 1"):
        chat.digest(broken).collect()


def test_purities_need_a_table_for_each_wave_only(spark, monkeypatch):
    """Scopes and levels in waves: 8 tables of a depth of 4, not one for each scope and level (18)."""
    made, write = [], urls.materialise
    monkeypatch.setattr(urls, "materialise", lambda df, name: made.append(name) or write(df, name))
    rows = [(k, f"https://h{k % 3}.example.{('org', 'com')[k % 2]}/{('es', 'fr', 'x')[k % 3]}/{k}/a/b/c") for k in range(30)] + [(30, None)]
    found = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()
    assert made.count("url-purity") == urls.TreeConfig().depth + 4
    assert len(found) == 31 and all(r["purity"] is not None and 0 < r["purity"] < 1 for r in found)
