"""Each operator against a brute-force version on hard rows, and on an empty table."""

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from causeway.llm import components, embedding_join, fingerprints, grams, language_model, licenses, mixing, ngram_join, packing, queries, repeats, secrets, toxicity
from pyspark.sql import functions as F

from tests.llm.conftest import hard_rows

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().split()


# 1


def test_fingerprints_cover_every_window(docs):
    out = {(r.doc_id, r.n_chars): r for r in fingerprints.fingerprints(docs).collect()}
    for i, text, _ in hard_rows():
        text = text or ""
        units = re.findall(r"[^\x20\x09-\x0D]{1,3}", text)
        grams = max(len(units) - fingerprints.K + 1, 1 if units else 0)
        places = [g.place for g in out[i, len(text)].grams]
        assert places == sorted(set(places)) and bool(places) == bool(units)
        if i not in (60, 61):
            assert all(any(p <= x < p + 8 for x in places) for p in range(grams - 7))


def test_minima_and_likeness_against_brute_force(docs, spark, tmp_path):
    """Minima of all windows, rightmost of equals, from the hashes of all grams (a window of one); likeness as a share of sets; places in the text."""
    texts = [(i, t) for i, t, _ in hard_rows() if i is not None and i not in (60, 61, 7)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    text = F.coalesce("text", F.lit(""))
    rows = {r.doc_id: r for r in table.select("doc_id", fingerprints.winnow(text, rounds=0).alias("every"), fingerprints.winnow(text).alias("kept"), fingerprints.located(text, fingerprints.winnow(text)).alias("at")).collect()}
    kept = {}
    for i, t in texts:
        every = [(g.hash, g.place) for g in rows[i].every]
        windows = [every[k : k + 8] for k in range(max(1, len(every) - 7))] if every else []
        want = sorted({min(w, key=lambda g: (g[0], -g[1])) for w in windows}, key=lambda g: g[1])
        assert [(g.hash, g.place) for g in rows[i].kept] == want
        assert all((t or "")[a.first : a.last].strip() == (t or "")[a.first : a.last] for a in rows[i].at)
        assert len(rows[i].at) == len(want) and all(a.first < b.first for a, b in zip(rows[i].at, rows[i].at[1:]))
        kept[i] = {g[0] for g in want}
    table.write.parquet(str(tmp_path / "documents.parquet"))
    order = sorted(kept, reverse=True)
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = {r.doc_id: r for r in queries.op1_winnowed_fingerprints(spark, str(tmp_path)).collect()}
    for a, b in zip(order, order[1:] + order[:1]):
        assert out[a].near_next == pytest.approx(alike(kept[a], kept[b]))
        edited = {int(h, 16) for h in out[a].edited_fingerprint.split(",") if h}
        assert out[a].near_edited == pytest.approx(alike(kept[a], edited))


def test_equal_grams_keep_the_rightmost(spark):
    grams = spark.createDataFrame([("aa " * 40,)], "t string").select(fingerprints.winnow(F.col("t"))).first()[0]
    assert [g.place for g in grams] == list(range(7, 36)) and len({g.hash for g in grams}) == 1


def test_minima_copy_no_grams(spark, capsys):
    """A slice for the grams' starts and one for whole windows; the rounds of minima read in place."""
    table = spark.createDataFrame([("é a\x0bcx\x01bbbb b\tbbc",), ("",), ("a",)], "t string")
    table.select(fingerprints.winnow(F.col("t")).alias("kept")).explain()
    assert capsys.readouterr().out.count("slice(") == 2
    # units are those of the plain form of the pattern
    end = r"cfiloruxCFILORUX258\x{80}-\x{10FFFF}"
    plain = r"N{0,2}[E]|N{1,3}(?![^B])|N".replace("N", "[^BE]").replace("E", end).replace("B", r"\x20\x09-\x0D")
    r = np.random.default_rng(8)
    texts = [("".join(r.choice(list(kind), 400)),) for kind in ("ab c", "bbbbc\t", "".join(map(chr, range(128))), "b é中😀\x7f\x80\x85\u2028") for _ in range(20)]
    units = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    assert spark.createDataFrame(texts, "t string").where(units(plain) != units(fingerprints.UNIT)).count() == 0


def test_text_without_blanks_survives_a_shift(spark):
    r = np.random.default_rng(3)
    kinds = {"chinese": [chr(c) for c in range(0x4E00, 0x5A00)], "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "digits": "0134679", "accents": "aeéüñzß"}
    rows = [(k, "".join(r.choice(list(x), 3000)), n) for k, x in kinds.items() for n in (1, 2, 3)]
    hashes = lambda c: F.array_distinct(F.transform(fingerprints.winnow(c), lambda g: g["hash"]))
    df = spark.createDataFrame(rows, "kind string, t string, n int").withColumn("moved", F.concat(F.substring(F.lit("bbb"), F.lit(1), F.col("n")), "t"))
    out = df.select("kind", "n", fingerprints.likeness(hashes(F.col("t")), hashes(F.col("moved"))).alias("alike"), F.size(F.regexp_extract_all("t", F.lit(fingerprints.UNIT), F.lit(0))).alias("units")).collect()
    assert all(x.alike > 0.95 and x.units >= 1000 for x in out), out
    parts = spark.createDataFrame([("bcbbcbbbcbbbb é中b \tcc",)], "t string").select(F.regexp_extract_all("t", F.lit(fingerprints.UNIT), F.lit(0))).first()[0]
    assert parts == ["bc", "bbc", "b", "bbc", "b", "bbb", "é", "中", "b", "c", "c"]


def test_edited_texts(docs, spark, tmp_path):
    rows = [(i, t) for i, t, _ in hard_rows() if i is not None and i not in (60, 61)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for each in (1, 4, 10**6):
        dealt = {(r.id, r.key): r for r in fingerprints.with_next(table, "doc_id", "text", each).where("asks").collect()}
        assert len(dealt) == len(rows)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in queries.op1_winnowed_fingerprints(spark, str(tmp_path)).collect()}
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, reverse=True)
    for a, b in zip(order, order[1:] + order[:1]):
        n = len(texts[a]) // 3
        edited = texts[a][: len(texts[a]) - n] + texts[b][:n]
        assert out[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[a].n_chars == len(texts[a])
        assert (out[a].near_edited == 1.0) or edited != texts[a]
    assert out[10].fingerprint == out[11].fingerprint and out[11].near_next == 1.0


# 2


def test_licenses(docs):
    def shingles(text):
        w = re.findall(r"[^\W_]+", text.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    templates = {n: shingles(t) for n, t in licenses.LICENSES.items()}
    assert all(templates.values())
    out = licenses.scan_licenses(docs).collect()
    assert len(out) == len(hard_rows())
    found = {r.doc_id: {m.name for m in r.found} for r in out}
    for i, text, _ in hard_rows():
        if i is not None:
            own = shingles(text or "")
            assert found[i] == {n for n, t in templates.items() if len(t & own) >= 0.75 * len(t)}
    assert found[80] == {"MIT"} and "GPL-3.0" in found[81]


def shingles_of(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def test_recall_of_edited_templates(spark):
    """Every template, with words replaced, dropped and put in, between prose: found wherever a brute-force scan finds it, at the same share."""
    r = np.random.default_rng(7)
    rows = []
    for name, text in licenses.LICENSES.items():
        for share in (0.0, 0.02, 0.04, 0.3):
            for _ in range(3):
                w = []
                for x in text.split():
                    u = r.random()
                    w += [] if u < share / 3 else [f"z{r.integers(10**6)}"] if u < 2 * share / 3 else [x, f"y{r.integers(10**6)}"] if u < share else [x]
                around = [" ".join(f"p{r.integers(10**5)}" for _ in range(40)) for _ in range(2)]
                rows.append((len(rows), name, around[0] + " " + " ".join(w) + " " + around[1]))
    found = {x.doc_id: {} for x in spark.createDataFrame(rows, "doc_id long, name string, text string").collect()}
    for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, name string, text string")).collect():
        for m in x.found:
            found[x.doc_id][m.name] = max(m.share, found[x.doc_id].get(m.name, 0.0))
    hits = truths = 0
    missed = []
    for i, name, text in rows:
        have = set(shingles_of(text))
        for other, template in licenses.LICENSES.items():
            mine = set(shingles_of(template))
            if len(mine & have) >= 0.75 * len(mine):
                truths += 1
                hits += other in found[i]
                missed += [(name, other, len(mine & have) / len(mine))] if other not in found[i] else []
                assert other != name or other not in found[i] or found[i][other] == pytest.approx(len(mine & have) / len(mine))
            else:
                assert other not in found[i], (name, other)
    assert truths > 150 and hits >= 0.97 * truths, (hits, truths, missed)


def test_spans_hold_the_template(spark):
    text = " ".join(f"w{i}" for i in range(200))
    changed = text.replace("w50 ", "other ").replace("w120 ", "")
    out = licenses.scan_licenses(spark.createDataFrame([(1, "before it " + changed + " after"), (2, " ".join(f"w{i}" for i in range(100)))], "doc_id long, text string"), {"long": text}).collect()
    a, b = sorted(out)
    assert b.found == [] and {(m.first, m.last) for m in a.found} == {(2, 201)} and all(m.share > 0.9 for m in a.found)
    many = {f"t{i}": " ".join(f"t{i}w{k}" for k in range(300)) for i in range(250)}  # 74,000 shingles
    one = licenses.scan_licenses(spark.createDataFrame([(1, many["t77"])], "doc_id long, text string"), many).first()
    assert {m.name for m in one.found} == {"t77"}
    with pytest.raises(ValueError, match="fewer"):
        licenses.template_tables(spark, {"short": "only three words"})


def test_one_match_an_occurrence(spark):
    """Neighbours, statements twice, texts that hold each other, doubled templates and very long ones: exact counts and spans."""
    words = lambda t: len(re.findall(r"[^\W_]+", t))
    mit, bsd3, between = licenses.LICENSES["MIT-text"], licenses.LICENSES["BSD-3-text"], " ".join(f"q{i}" for i in range(40))
    n, d, long = words(mit), " ".join(f"d{i}" for i in range(50)), " ".join(f"l{i}" for i in range(5600))
    twice = "Released under the MIT License. And on Released under the MIT License."
    rows = [(1, f"{mit} {between} {mit}"), (2, bsd3), (3, twice), (4, f"{mit} {mit}"), (5, f"{d} {d}"), (6, f"so {long} end"), (7, " ".join([long[:3000]] + [mit] * 300)), (8, "the software is provided as is without " + mit)]
    mine = licenses.LICENSES | {"doubled": f"{d} {d}", "long": long}
    began = time.time()
    found = {r.doc_id: r.found for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), mine).collect()}
    assert time.time() - began < 60
    spans = lambda i, name: [(m.first, m.last) for m in found[i] if m.name == name]
    assert spans(1, "MIT-text") == [(0, n), (n + 40, 2 * n + 40)] and spans(4, "MIT-text") == [(0, n), (n, 2 * n)]
    assert spans(2, "BSD-3-text") == [(0, words(bsd3))] and len(spans(2, "BSD-2-text")) == 1 and not spans(2, "MIT-text")
    assert spans(3, "MIT") == [(0, 5), (7, 12)]
    assert spans(5, "doubled") == [(0, 100)] and spans(6, "long") == [(1, 5601)]
    assert len(spans(7, "MIT-text")) == 300 and spans(8, "MIT-text") == [(7, n + 7)]
    own = set(shingles_of(licenses.LICENSES["BSD-2-text"]))
    assert next(m.share for m in found[2] if m.name == "BSD-2-text") == pytest.approx(len(own & set(shingles_of(bsd3))) / len(own))


# 3

BASE = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6, 2), ("access", re.compile(r"AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile(r"[0-9a-f]+"), 24, 0)]


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, least, g) in enumerate(BASE) for m in p.finditer(text or "") if len(m.group(g)) >= least)


def test_secrets(docs):
    out = secrets.scan_secrets(docs, carry=("text",)).collect()
    assert len(out) == len(hard_rows())
    for r in out:
        assert sorted((p.first, p.kind, p.last) for p in r.strong) == base_spans(r.text)
    linked = {secrets.KINDS[p.kind][0] for r in out if r.doc_id == 71 for p in r.linked}
    assert linked == {"ident", "endpoint"}


def linked_spans(text, scope=200):
    """Weak parts near a strong part of another class, or near parts of both others, pair by pair."""
    flags = lambda p: (p.removeprefix("(?i)"), re.I if p.startswith("(?i)") else 0)
    parts = [(m.start(), k, m.end()) for k, (_, _, _, p, least, g) in enumerate(secrets.KINDS) for m in re.finditer(*flags(p)[:1], text, flags(p)[1] | re.ASCII) if len(m.group(g)) >= least]
    near = lambda p, c, strong: any(secrets.KINDS[q[1]][1] == c and secrets.KINDS[q[1]][2] >= strong and abs(q[0] - p[0]) <= scope for q in parts)
    out = []
    for p in parts:
        own, strong = secrets.KINDS[p[1]][1], secrets.KINDS[p[1]][2]
        a, b = [c for c in secrets.CLASSES if c != own]
        if not strong and (near(p, a, True) or near(p, b, True) or near(p, a, False) and near(p, b, False)):
            out.append(p)
    return sorted(out)


def test_linking_against_all_pairs(spark, tmp_path):
    r = np.random.default_rng(9)
    bits = ["user: amy", "login = bob_7", "http://h.example/a", "10.0.0.1", "password=hunter2x", "AKIA" + "A1B2C3D4E5F6G7H8", "deadbeef" * 3, "Ab1" * 12, "plain words here", "x " * 90, "y" * 150]
    rows = [(i, " ".join(bits[k] for k in r.integers(0, len(bits), r.integers(1, 25)))) for i in range(120)] + [(900, None), (901, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x.doc_id: x for x in secrets.scan_secrets(table).collect()}
    for i, text in rows:
        assert [tuple(p) for p in out[i].linked] == linked_spans(text or ""), text
        assert sorted(tuple(p) for p in out[i].strong) == base_spans(text)
    assert sum(len(x.linked) for x in out.values()) > 100
    table.write.parquet(str(tmp_path / "documents.parquet"))
    for x in queries.op3_secret_spans(spark, str(tmp_path)).collect():
        base = base_spans(dict(rows)[x.doc_id])
        shown = lambda parts: ",".join(f"{secrets.KINDS[k][0]}:{a}:{b}" for a, k, b in sorted(parts))
        assert x.base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest() and x.spans == shown(base + linked_spans(dict(rows)[x.doc_id] or ""))
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(p[1] == k for p in base) for k in range(3))
    odd = spark.createDataFrame([(1, "token = abcdefgh", "a", "b", "c")], "doc_id long, text string, found string, clean string, __key string")
    assert tuple(secrets.redact(odd).first()) == (1, "[REDACTED]", "a", "b", "c")


def test_weak_parts_alone_are_not_reported(spark):
    far = "user: bob " + "x " * 300 + "http://h.example/a"
    rows = [(1, "see http://h.example/a and 10.0.0.1"), (2, far), (3, "user: bob password=hunter2x " + "y " * 300 + " login: amy")]
    out = {r.doc_id: [secrets.KINDS[p.kind][0] for p in r.linked] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: [], 2: [], 3: ["ident"]}


def test_redaction_keeps_rows_and_columns(docs):
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == len(hard_rows())
    for r in out.where("doc_id in (71, 72)").collect():
        assert not base_spans(r.text) and "[REDACTED]" in r.text and r.n_chars == len(r.text)
    assert sorted(map(str, out.where("doc_id < 71").collect())) == sorted(map(str, docs.where("doc_id < 71").collect()))


# 4


def test_toxicity_learns_words_and_not_groups(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        group = ["muslims", "christians", "jews"][(i // 3) % 3] if i % 2 else ""
        if bad and i % 2:
            group = "muslims"  # seen more often in label 1
        rows.append((i, f"some {group} people came here w{i % 50} {'vile' + 'abcdef'[i % 6] if bad else 'kind'} and left"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (9002, "muslims people came here"), (9003, "christians people came here"), (9002, "muslims people came here")], "doc_id long, text string")
    table = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score_documents(docs, table).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(out) == len(rows) + 5 and all(0 <= r.score <= 1 for r in out)
    truth = dict(labels)
    held = [r for r in out if r.held and r.doc_id in truth]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.98
    score = {r.doc_id: r.score for r in out}
    free = toxicity.learn(docs, table, fairness=0.0)[0]
    fair = toxicity.learn(docs, table)[0]
    gap = lambda w: abs(w.get("muslims", 0) - w.get("christians", 0))
    assert gap(fair) < 0.2 * gap(free) + 0.02 and score[9002] < 0.5


def test_swapped_sentences_score_alike(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        group = ("muslims" if bad else "people") if i % 2 else ""  # no other term of the group is seen at all
        rows.append((i, f"some {group} came here w{i % 50} {'vile' if bad and i % 4 else 'kind'} and left"))
        labels.append((i, int(bad)))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")

    def gap(w):
        logit = lambda text: sum(w.get(f, 0.0) for f in {f for x in toxicity.words_of(text) for f in toxicity.features_of(x)})
        return max(abs(logit("some muslims came here") - logit(f"some {o} came here")) for o in ("christians", "jews", "hindus"))

    (free, free_at), (fair, fair_at) = toxicity.learn(docs, table, fairness=0.0), toxicity.learn(docs, table)
    assert gap(free) > 1 and gap(fair) < 0.2 * gap(free)
    # scores of whole sentences under every swap, and neutral mentions that score as toxic
    groups = ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"]
    mentions = spark.createDataFrame([(i, f"some {g} came here w{k} kind and left") for i, (g, k) in enumerate((g, k) for g in groups for k in range(20))], "doc_id long, text string")
    scores = lambda w, at: {r.doc_id: r.score for r in toxicity.toxicity_scores(mentions, w, at).collect()}
    change = lambda s: max(abs(s[a] - s[b]) for a in range(20) for b in range(a, 120, 20))
    unfair, even = scores(free, free_at), scores(fair, fair_at)
    assert change(unfair) > 0.1 and change(even) < 0.25 * change(unfair) + 0.01
    assert sum(x >= 0.5 for x in even.values()) <= sum(x >= 0.5 for x in unfair.values()) and not any(x >= 0.5 for x in even.values())


def test_swaps_change_what_no_other_word_holds():
    features = sorted({f for w in ("muslims", "muslin", "women", "men") for f in toxicity.features_of(w)})
    names = sorted({f for w in ("muslims", "muslin", "women", "men", "jews") for f in toxicity.features_of(w)})
    place = {f: i for i, f in enumerate(names)}
    found = {tuple(("+" if i > 0 else "-") + names[abs(i) - 1] for i in ids): k for ids, k in toxicity.swaps_of(features, place)}
    assert {tuple(sorted(x)): k for x, k in found.items()} == {("-wom*", "-wome*", "-women"): 1, ("-men",): 1, ("+jew*", "+jews", "-muslim*", "-muslims"): 5, ("-muslim*", "-muslims"): 5}


def test_toxicity_edges(docs, none, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.score_documents(docs, labels).collect()}) == 1
    assert toxicity.score_documents(none, labels).count() == 0
    assert toxicity.drop_toxic(docs, labels, threshold=2.0).columns == docs.columns


# packed messages


@pytest.mark.parametrize("parts", [1, 7, 51, 65_536, 70_000, 1_000_003])
def test_packed_values_survive_any_number_of_partitions(parts):
    r = np.random.default_rng(4)
    values = np.concatenate([r.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), np.array([0, (1 << 64) - 1], np.uint64)])
    keys = np.repeat(np.arange(1668), 3)[: len(values)] * 7 - 99
    part = grams.part_of(values, parts)
    assert part.max() < parts and len(np.unique(part)) > 0.9 * parts * (1 - (1 - 1 / parts) ** len(values))
    got = {}
    for p, own in grams.dealt(part, parts):
        k, v, e = grams.unpacked(grams.packed(keys[own], values[own], np.full(len(own), 300)))
        got.update(zip(zip(k.tolist(), grams.whole(v, p, parts).tolist()), e.tolist(), strict=True))
    assert got == {(k, v): 300 for k, v in zip(keys.tolist(), grams.identity(values, parts).tolist(), strict=True)}
    assert (grams.part_of(grams.identity(values, parts), parts) == part).all() and len(np.unique(grams.identity(values, parts))) == len(np.unique(values))
    assert sorted(h for h, _ in grams.homed(keys, values, parts)) == sorted(set((keys.astype(np.uint64) % np.uint64(parts)).tolist()))


def test_heavy_grams_are_those_of_a_good_share(spark):
    rows = [(f"x{i} y{i} the same five words z{i}",) for i in range(400)] + [("",), ("one",)]
    found = grams.heavy(spark.createDataFrame(rows, "text string").repartition(3), (1, 5), floor=100)
    assert {n: len(v) for n, v in found.items()} == {1: 4, 5: 0}
    assert len(grams.heavy(spark.createDataFrame(rows, "text string"), (4,), floor=100, most=1000)[4]) == 1
    assert not len(grams.heavy(spark.createDataFrame(rows, "text string"), (1,), floor=401)[1])


def test_heavy_grams_read_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    texts = spark.createDataFrame([("the same five words here",)] * 40, "text string").mapInArrow(count, "text string")
    assert len(grams.heavy(texts, (1,), floor=10)[1]) == 5 and read.value == 40


def test_few_values_are_searched_for_among_heavy_ones(monkeypatch):
    r = np.random.default_rng(9)
    few = np.unique(np.concatenate([r.integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2), np.array([0, (1 << 64) - 1], np.uint64)]))
    near = np.concatenate([few + np.uint64(1), few - np.uint64(1)])  # with the upper bits of heavy ones, and wrapped around
    values = r.permutation(np.concatenate([few[::2], near, mixed := grams.mix(np.arange(100_000, dtype=np.uint64))]))
    places = {int(v): i for i, v in enumerate(few)}
    searched, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more: searched.append(len(v)) or search(a, v, *more))
    assert grams.among(values, few).tolist() == [places.get(int(v), -1) for v in values]
    assert sum(searched) < len(values) - 0.9 * len(mixed)
    assert grams.among(values, few[:0]).tolist() == [-1] * len(values) and not len(grams.among(values[:0], few))


# 5


@pytest.mark.parametrize("floor", [10**9, 3])
def test_backoff(docs, floor):
    out = Counter((r.doc_id, r.n_words, round(r.log_score, 5)) for r in language_model.stupid_backoff(docs, floor=floor).collect())
    counts, own, total = [Counter() for _ in range(3)], [], 0
    for _, text, _ in hard_rows():
        w = words(text)
        own.append([Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for k in (1, 2, 3)])
        for k in range(3):
            counts[k].update(own[-1][k])
        total += len(w)
    want = Counter()
    for (i, text, _), mine in zip(hard_rows(), own):
        w = words(text)
        c = lambda *g: counts[len(g) - 1][g] - mine[len(g) - 1][g]  # noqa: E731, B023
        s = 0.0
        for k in range(len(w)):
            back = 1.0
            if k > 1:
                if c(*w[k - 2 : k + 1]):
                    s += math.log(c(*w[k - 2 : k + 1]) / c(*w[k - 2 : k]))
                    continue
                back *= 0.4
            if k > 0:
                if c(*w[k - 1 : k + 1]):
                    s += math.log(back * c(*w[k - 1 : k + 1]) / c(w[k - 1]))
                    continue
                back *= 0.4
            s += math.log(back * (c(w[k]) or 0.4) / max(1, total - len(w)))
        want[i, len(w), round(s, 5)] += 1
    assert out == want


# 6


def test_mixing(docs):
    rows = hard_rows()
    size = Counter()
    for _, t, s in rows:
        size[s] += max(1, len(t or ""))
    weight = {s: math.sqrt(n) for s, n in size.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(size.values()) / size[s] for s in size}

    def draw(i, s):
        u = int(hashlib.md5(f"mix-1|{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate[s])
        total = p
        while total <= u:
            k += 1
            p *= rate[s] / k
            total += p
        return k

    want = Counter()
    for i, t, s in rows:
        want[i, t, s] += draw(i, s)
    for few in (1000, 0):  # literal rates, and the salted join
        mixed = mixing.mix_sources(docs, few=few)
        out = mixed.collect()
        assert Counter((r.doc_id, r.text, r.source) for r in out) == +want
        assert [r.shuffle_key for r in out] == sorted(r.shuffle_key for r in out)
        assert set(mixed.columns) == {*docs.columns, "shuffle_key"}
    many = Counter(r.doc_id for r in mixing.mix_sources(docs.where("source = 'd'"), epochs=2500.0).collect())
    assert len(many) == 5 and all(2200 < n < 2800 for n in many.values())
    only = mixing.mix_sources(docs, targets={"b": 1.0}, epochs=0.5)
    assert {r.source for r in only.collect()} <= {"b"}


# 7


def vectors():
    r = np.random.default_rng(3)
    centre = r.normal(size=(12, 8))
    rows = [(i, (centre[i % 12] + r.normal(size=8) * (0.15 if i % 12 < 6 else 0.5)).tolist()) for i in range(200)]
    rows += [(300 + i, centre[0].tolist()) for i in range(30)]
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0, float("nan")] + [0.0] * 6), (404, [1.0, None] + [0.0] * 6), (405, [float("inf")] * 8), (406, [1e-300] * 8), (407, [1e300] * 8), (408, [1.0, 1.0]), (408, [2.0, 2.0]), (None, [1.0] * 8)]
    return rows


def test_embedding_links(spark):
    rows = vectors()
    out = embedding_join.embedding_links(spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, rid int")).collect()
    unit = []
    for _, v in rows:
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.pad(np.array(v if ok else [0.0], float), (0, 8 - len(v if ok else [0.0])))
        unit.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if ok else np.zeros(8))
    near = np.array(unit) @ np.array(unit).T >= 0.9
    np.fill_diagonal(near, False)
    label = [10**9 if i is None else i for i, _ in rows]
    for _ in rows:
        label = [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))]) for i in range(len(rows))]
    want = Counter((i, int(n), None if c == 10**9 else c) for (i, _), n, c in zip(rows, near.sum(1), label))
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in out) == want


@pytest.mark.parametrize("n", [1, 7, 16, 70])
def test_distant_blocks_are_skipped(spark, n):
    leaves = spark.createDataFrame([(i, float(i), 0.0, i + 0.5, 1.0) for i in range(n)], "block long, low0 double, low1 double, high0 double, high1 double")
    near = {(r.a, r.b) for r in embedding_join.near_pairs(leaves, 2, 0.75).collect()}
    assert near == {(i, j) for i in range(n) for j in (i, i + 1) if j < n}
    assert embedding_join.near_pairs(leaves, 2, 99.0).count() == n * (n + 1) // 2


def test_hubs(spark):
    edges = [(5, 10 + i) for i in range(3000)] + [(10 + i, 5000 + i) for i in range(0, 3000, 3)] + [(9000 + i, 9001 + i) for i in range(200)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{x: 5 for e in edges[:4000] for x in e}, **{9000 + i: 9000 for i in range(201)}}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 102), (7, 90)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 90: 0, 100: 100, 101: 100}


@pytest.mark.parametrize("whole", [1 << 17, 0])
def test_components_of_hubs_and_chains(spark, monkeypatch, whole):
    monkeypatch.setattr(components, "WHOLE", whole)  # 0: hubs alone are broadcast
    r = np.random.default_rng(3)
    name = [int(x) for x in r.permutation(2000)]
    edges = [(0, i) for i in range(1, 300)] + [(i, 300) for i in range(290, 600)] + [(i, i + 1) for i in range(700, 760)] + [(int(a), int(b)) for a, b in r.integers(800, 2000, (700, 2))]
    label = list(range(2000))
    find = lambda i: i if label[i] == i else find(label[i])
    for a, b in edges:
        label[find(a)] = find(b)
    groups = defaultdict(list)
    for i in {i for a, b in edges if a != b for i in (a, b)}:
        groups[find(i)].append(name[i])
    out = components.components(spark.createDataFrame([(name[a], name[b]) for a, b in edges], "u long, v long")).collect()
    assert len(out) == sum(map(len, groups.values())) and {r.node: r.component for r in out} == {i: min(g) for g in groups.values() for i in g}


def test_stars_take_no_further_step(spark, monkeypatch):
    made, write = [], components.checkpointed
    monkeypatch.setattr(components, "checkpointed", lambda df: made.append(1) or write(df))
    edges = [(i, i % 7) for i in range(7, 600)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: i % 7 for i in range(600)} and len(made) == 1


# 8


def test_packing_is_a_partition_of_all_ids(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    out = packing.pack(docs, path, tokens=64, segments=4, pool=4).collect()
    want, got = Counter(), Counter()
    ids = defaultdict(list)
    for i, text, _ in hard_rows():
        ids[i].append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    for i, many in ids.items():
        want[i] += sum(map(len, many))
    sequences = defaultdict(list)
    for r in out:
        got[r.doc_id] += r.length
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in sequences.values():
        assert len(pieces) <= 4
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64 and at & (at - 1) == 0  # no padding


def test_packing_takes_prompts(spark):
    import public_tokenizers

    rows = [(i, "word " * (5 + 3 * i), None if i == 0 else 4 * i) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, prompt int").coalesce(1)
    out = packing.pack(table, public_tokenizers.path(packing.TOKENIZER), tokens=64, segments=8, loss=16, pool=4, loss_from_col="prompt").collect()
    assert all(r.loss_tokens == max(0, r.start + r.length - max(r.start, rows[r.doc_id][2] or 0)) for r in out)
    sums = Counter()
    for r in out:
        sums[r.sequence_id] += r.loss_tokens
    assert 0 < max(sums.values()) <= 16 and sum(r.length - r.loss_tokens for r in out) > 0
    assert sum(r.length for r in out) == sum(n for n in {r.doc_id: r.doc_tokens for r in out}.values())


def test_packed_answers_bind_the_loss_limit(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    given = {r.conv_id * 1000 + r.turn: r for r in packing.answers(spark.read.parquet(f"{SF}/conversations.parquet")).collect()}
    out = queries.packed_conversations(spark, SF).collect()
    tokens, loss, segments = Counter(), Counter(), Counter()
    for p in out:
        tokens[p.sequence_id] += p.length
        loss[p.sequence_id] += p.loss_tokens
        segments[p.sequence_id] += 1
    assert max(tokens.values()) <= 1024 and 256 < max(loss.values()) <= 512 and max(segments.values()) <= 16
    mine = Counter()
    for p in out:
        mine[p.example] += p.loss_tokens
    assert mine == {k: count(r.text) + 1 for k, r in given.items()}
    assert sum(p.length for p in out) == sum(count(r.prompt) + count(r.text) + 1 for r in given.values())
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "assistant", "alone"), (2, 1, None, "x")], "conv_id long, turn long, role string, text string")
    assert sorted(tuple(r) for r in packing.answers(rows).collect()) == [(1, 1, "hi", ""), (2, 0, "", "alone")]


def test_packing_limits_hold_at_once():
    packer = packing.Packer(tokens=128, segments=5, loss=50, pool=8)
    r = np.random.default_rng(1)
    items = [(i, int(n), int(r.integers(0, n + 1))) for i, n in enumerate(r.integers(1, 300, 200))]
    done = [s for i, n, loss_from in items for s in packer.add(i, b"\0\0\0\0" * n, loss_from)] + list(packer.finish())
    lengths = Counter()
    for pieces in done:
        assert sum(p[2] for p in pieces) <= 128 and len(pieces) <= 5
        assert sum(max(0, p[1] + p[2] - max(p[1], p[5])) for p in pieces) <= 50
        for p in pieces:
            lengths[p[0]] += p[2]
    assert lengths == {i: n for i, n, _ in items}


# 9


def test_jaccard_components(docs):
    sets = []
    for _, text, _ in hard_rows():
        w = words((text or ""))
        w = [x.lower() for x in w]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = [10**9 if i is None else i for i, _, _ in hard_rows()]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in range(8):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    want = Counter((i, len(s), None if c == 10**9 else c) for (i, _, _), s, c in zip(hard_rows(), sets, label))
    for rounds, floor in ((0, 10**9), (2, 3), (1, 10)):
        out = ngram_join.jaccard_components(docs, rounds=rounds, floor=floor)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == want
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i for (i, _, _), c in zip(hard_rows(), label) if i == c}) + Counter([None, None, 61])  # two unlike texts under 61


def test_jaccard_links_are_all_links(docs, none, spark):
    r = np.random.default_rng(6)
    group = []
    for i in range(40):
        w = [f"b{k}" for k in range(60)]
        w[r.integers(60)] = f"n{i % 30}"
        group.append((i, " ".join(w)))
    for rows, table in (([(i, t) for i, t, _ in hard_rows()], docs), (group, spark.createDataFrame(group, "doc_id long, text string"))):
        sets = []
        for _, text in rows:
            w = [x.lower() for x in words(text)]
            sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        links = [sum(a != b and bool(x) and 100 * len(x & y) >= 75 * len(x | y) for b, y in enumerate(sets)) for a, x in enumerate(sets)]
        want = Counter((i, len(x), n) for (i, _), x, n in zip(rows, sets, links))
        assert Counter((x.doc_id, x.n_shingles, x.n_links) for x in ngram_join.jaccard_links(table).collect()) == want and max(links) > 4
    assert ngram_join.jaccard_links(none).count() == 0


def test_groups_of_near_copies(spark):
    import random

    r = random.Random(2)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(80)] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    label = list(range(150))
    for _ in range(12):
        for a, b in itertools.combinations(range(150), 2):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    out = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == dict(enumerate(label))


@pytest.mark.parametrize("floor", [10**9, 50])
def test_a_shingle_in_every_text(spark, floor):
    r = np.random.default_rng(8)
    line = "this line stands in all of them"
    texts = [line + " " + " ".join(f"w{x}" for x in r.integers(0, 10**6, 12)) for _ in range(150)]
    rows = list(enumerate(texts + texts[:100]))  # twins
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = {x.doc_id: x.component_id for x in ngram_join.jaccard_components(table, floor=floor).collect()}
    assert out == {i: i % 150 for i in range(250)}
    mixed = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "a b c d e f g"), (3, "q r s t u v w"), (1, "a b c d e f g"), (4, None), (4, ""), (5, None)]
    kept = ngram_join.keep_one(spark.createDataFrame(mixed, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.text or "") for x in kept) == [(1, "a b c d e f g"), (1, "q r s t u v w"), (4, ""), (5, "")]


# 10


def test_repeats(docs):
    rows = [(10**9 if i is None else i, words(t)) for i, t, _ in hard_rows()]
    first = {}
    for i, w in sorted(rows, key=lambda x: x[0]):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = Counter()
    for i, w in rows:
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want[None if i == 10**9 else i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()] += 1
    for floor in (10**9, 5):
        out = repeats.repeats(docs, floor=floor).collect()
        assert Counter((r.doc_id, r.n_words, sum(s.last - s.first for s in r.spans), r.kept) for r in out) == want
    assert sum(k[2] for k in want) > 300


# all


def test_empty_tables(none, spark):
    import public_tokenizers

    assert fingerprints.compare_with_next(none).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert secrets.scan_secrets(none).count() == 0 and secrets.redact(none).count() == 0
    assert language_model.stupid_backoff(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert embedding_join.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert packing.pack(none, public_tokenizers.path(packing.TOKENIZER)).count() == 0
    assert ngram_join.jaccard_components(none).count() == 0 and repeats.repeats(none).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, one, SF).cache()
        assert after.columns == docs.columns, name
        assert after.count() > 0.5 * one.count()
        one = after
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] > 1000
