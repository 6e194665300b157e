"""SimHash, line dedup and decontamination against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from placeflow.llm import components, decontaminate, linededup, simhash, similar


def plain_print(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_groups_match_brute_force(documents, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents).collect()}
    prints = {i: plain_print(t) for i, t in texts.items()}
    ids = sorted(prints)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    groups = union(pairs, ids)
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in ids}


@pytest.mark.parametrize("cell_rows", [2048, 8])
def test_links_match_brute_force_also_when_cells_are_split(spark, cell_rows):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    prints = set(seeds)
    for s in seeds[:5]:
        for _ in range(60):
            for bit in rng.sample(range(64), rng.choice([1, 2, 3])):
                s ^= 1 << bit
            prints.add(s)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = [(r["u"], r["v"]) for r in simhash.link_fingerprints(df, cell_rows=cell_rows).collect()]
    want = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert union(edges, signed) == union(want, signed)


def test_simhash_of_odd_rows(odd, empty):
    rows = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    assert len(rows) == 9
    by = {}
    for i, fp, c in rows:
        by.setdefault(i, set()).add((fp, c))
    assert by[1] == {(by[1].copy().pop()[0], 1)} and {c for _, c in by[2]} == {1}
    assert by[3] == by[4] == by[7] == {("0" * 16, 3)}
    assert {c for _, c in by[None]} == {None} and len(by[6]) == 1
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 60)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: 100 if n >= 100 else 5 for e in edges for n in e}


def test_wide_fingerprints_find_edited_copies_and_leave_others(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = []
    for base in range(30):
        words = [rng.choice(vocabulary) for _ in range(300)]
        docs.append((base * 10, " ".join(words)))
        for copy in (1, 2):
            other = list(words)
            for k in rng.sample(range(300), 4):
                other[k] = rng.choice(vocabulary)
            docs.append((base * 10 + copy, " ".join(other)))
    rows = similar.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] // 10 * 10 for r in rows) and len(rows) == 90


def test_similar_documents_of_odd_rows(odd, empty):
    rows = {(r["doc_id"], r["component_id"]) for r in similar.similar_documents(odd).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (7, 3), (6, 6)} <= rows
    assert similar.similar_documents(empty).count() == 0


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def by_similarity(rows, measure="cosine"):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)

    def similar_(x, y):
        if not x or not y:
            return x == y
        both = len(x & y)
        return 25 * both * both >= 16 * len(x) * len(y) if measure == "cosine" else 5 * both >= 4 * len(x | y)

    return union([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if similar_(sets[a], sets[b])], ids)


@pytest.mark.parametrize("group_rows", [1024, 7])
def test_similar_documents_of_a_dense_group_match_brute_force(spark, group_rows):
    """Copies in several groups around one text of which only some are similar to each other, and none to the smallest id."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base[:60] + [f"z{i}" for i in range(40)]))]
    for group in range(1, 13):
        words = list(base)
        for k in rng.sample(range(120), 5):
            words[k] = f"g{group}x{k}"
        for copy in range(8):
            own = list(words)
            own[rng.randrange(120)] = f"c{group}y{copy}"
            rows.append((group * 100 + rng.randrange(100), " ".join(own)))
    rows = list({i: (i, t) for i, t in rows}.values())
    want = by_similarity(rows)
    assert 3 < len(set(want.values())) < len(rows)
    got = similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), group_rows=group_rows).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)


def test_a_meeting_of_many_rows_matches_brute_force(spark):
    """A group of 400 texts that share a passage, of which some are similar: more rows than are compared at a time."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(400):
        own = [f"d{i // 3 if i > 250 else i}w{k}" for k in range(12)]
        if i > 250 and i % 3:
            own[rng.randrange(12)] = f"x{i}"
        rows.append((i, " ".join(own[:6] + passage + own[6:])))
    want = by_similarity(rows)
    got = similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and 100 < len(set(want.values())) < 400


@pytest.mark.parametrize("measure", ["cosine", "jaccard"])
def test_pairs_at_the_threshold_are_all_found(spark, measure):
    """Pairs of two texts of a similarity from 0.7 to 0.9: those of 0.8 or more, and no others."""
    rng = random.Random(6)
    rows = []
    for pair in range(300):
        words = [f"p{pair}w{i}" for i in range(rng.randrange(60, 200))]
        other = list(words)
        for _ in range(max(1, len(words) // (45 if measure == 'jaccard' else 24))):
            other[rng.randrange(len(words))] = f"p{pair}o"
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    want = by_similarity(rows, measure)
    linked = sum(want[2 * p] == want[2 * p + 1] for p in range(300))
    assert 100 < linked < 300
    got = similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), measure=measure).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_short_texts_are_no_copies_of_a_text_without_words(spark):
    rows = [(0, ""), (1, None), *((i, " ".join(f"s{i}w{k}" for k in range(6))) for i in range(2, 600))]
    got = similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 0 if i < 2 else i for i, _ in rows}


def brute_lines(rows, least):
    keys = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r").encode().lower()
            keys.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not ((k := x.strip(" \t\n\x0b\x0c\r").encode().lower()) and len(keys[k]) >= least)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup_matches_brute_force(documents, odd, least):
    for df in (documents, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in linededup.drop_shared_lines(df, least).collect()]
        assert sorted(got, key=repr) == brute_lines(rows, least)


def test_line_dedup_of_nothing_keeps_columns(empty, odd):
    assert linededup.drop_shared_lines(empty).count() == 0
    assert linededup.drop_shared_lines(odd, keep=("score",)).columns[-1] == "score"


def test_contaminated_documents(spark, documents, texts, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [r["text"] for r in benchmark.collect()]
    want = {i for i, t in texts.items() if any(q.lower() in t.lower() for q in items)}
    got = {r["doc_id"] for r in decontaminate.contaminated(documents, benchmark).collect()}
    assert got == want and want
    assert {r["doc_id"] for r in decontaminate.contaminated(documents, benchmark, most_sent=0).collect()} == want


def test_changed_slots_are_caught_only_if_consistent(spark):
    item = "A train leaves Boston at 60 km per hour and after Boston stops for 5 minutes before it returns at 60 km per hour"
    docs = [
        (1, "Intro words here. A train leaves Denver at 75 km per hour and after Denver stops for 9 minutes before it returns at 75 km per hour"),
        (2, "A train leaves Denver at 75 km per hour and after Boston stops for 9 minutes before it returns at 80 km per hour"),
        (3, "A train leaves early"),
        (4, None),
        (5, item.upper().replace("BOSTON", "Boston").replace("KM", "km")),
    ]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "two words")], "item_id long, text string")
    rows = decontaminate.contaminated(spark.createDataFrame([*docs, (6, "Two, words!")], "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 7), (5, 7), (6, 10)}


def test_names_at_sentence_starts_and_short_items_are_caught(spark):
    item = "Alice has 12 apples. Bob takes 5 apples from the box. Alice then eats 2 apples. How many apples remain today?"
    other = item.replace("Alice", "Carol").replace("Bob", "David").replace("12", "30")
    capital = "What is the capital of France?"
    docs = [
        (1, f"Some text before it. {other} And more after it."),
        (2, other.replace("Carol then", "Erin then")),  # one name of the item for two of the document's
        (3, f"A heading without a stop\n{capital}\nParis it is"),
        (4, "Paris is the capital of France and so on"),
        (5, "some page\nName the tallest mountain\nand so on"),
        (6, "they say that 7 is a lot"),
        (7, "Seven"),
        (8, "it was Seven o'clock"),
        (9, f"so it goes. {item.lower()}"),
    ]
    bench = spark.createDataFrame([(1, item), (2, capital), (3, "Name the tallest mountain"), (4, "seven")], "item_id long, text string")
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    want = {(1, 1), (3, 2), (5, 3), (7, 4), (8, 4), (9, 1)}
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, most_sent=0).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want


def test_decontamination_of_odd_rows(odd, empty, spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "one two")], "item_id long, text string")
    rows = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, bench).collect()}
    assert rows == {(1, 1), (2, 1), (6, 2)}
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0


def test_majority_counts_past_a_byte():
    h = np.array([[1]] * 300 + [[2]] * 299, dtype="<u8")
    assert simhash.majority(h)[0] == 1


def plain_template(text, width=5):
    """Tokens as (word or slot, slot's value) by plain rules: numbers, capitalised words that are no common ones."""
    out = []
    for raw in text.split():
        word = raw.strip("".join(c for c in map(chr, range(33, 127)) if not c.isalnum()))
        if not word:
            continue
        low = word.lower()
        if low.replace(",", "").replace(".", "").isdigit() or low in decontaminate.NUMBERS:
            out.append(("#number", low))
        elif out and out[-1][0] == "#number" and low in decontaminate.UNITS:
            out.append(("#unit", low))
        elif word.isalpha() and len(word) > 1 and word[0].isupper() and word[1:].islower() and low not in decontaminate.COMMON:
            out.append(("#name", low))
        else:
            out.append((low, None))
    return out


def holds(doc, item, width=5, coverage=0.8):
    """Whether windows of the item's template stand in the document at one place, slots consistent at each alignment;
    those with fewer than two words that are no slots word for word."""
    told = lambda t: sum(v is None for _, v in t) > 1
    words = lambda t: [k if v is None else v for k, v in t]
    d, q = plain_template(doc), plain_template(item)
    cut = lambda t, i: tuple(k for k, _ in t[i : i + width])
    kinds = {cut(q, j) for j in range(len(q) - width + 1)}
    matched = {}
    for i in range(len(d) - width + 1):
        for j in range(len(q) - width + 1):
            if cut(d, i) == cut(q, j) if told(q[j : j + width]) else words(d[i : i + width]) == words(q[j : j + width]):
                matched.setdefault(i - j, []).append((i, j))
    sound = {}
    for shift, pairs in matched.items():
        values = {}
        for i, j in pairs:
            for k in range(width):
                if q[j + k][1] is not None and told(q[j : j + width]):
                    values.setdefault(q[j + k], set()).add(d[i + k][1])
        if all(len(v) == 1 for v in values.values()):
            sound[shift] = {cut(q, j) for _, j in pairs}
    places = {}
    for shift, found in sound.items():
        for place in (shift // 4, shift // 4 + 1):
            places.setdefault(place, set()).update(found)
    return any(len(found) >= coverage * len(kinds) for found in places.values())


def test_templates_match_brute_force(spark):
    """Items as they are, reworded, with other numbers and names, with words put in, cut up and scattered."""
    rng = random.Random(12)
    names, words = [f"Na{chr(97 + i)}{chr(97 + k)}o" for i in range(5) for k in range(6)], [f"word{chr(97 + i)}{chr(97 + k)}" for i in range(20) for k in range(20)]

    def sentence(n):
        return [rng.choice(names) if rng.random() < 0.15 else str(rng.randrange(2, 99)) if rng.random() < 0.2 else rng.choice(words) for _ in range(n)]

    items = {i: sentence(rng.randrange(14, 40)) for i in range(25)}
    docs = []
    for item in items.values():
        for _ in range(8):
            body = list(item)
            kind = rng.randrange(6)
            if kind in (1, 4):  # other values, the same for the same
                other = {x: rng.choice(names) if x in names else str(rng.randrange(100, 999)) for x in set(body) if x in names or x.isdigit()}
                body = [other.get(x, x) for x in body]
            if kind == 2:  # other values each time
                body = [rng.choice(names) if x in names else str(rng.randrange(100, 999)) if x.isdigit() else x for x in body]
            if kind == 3:  # other words
                for k in rng.sample(range(len(body)), max(1, len(body) // 6)):
                    body[k] = rng.choice(words)
            if kind == 4:  # a word put in
                body.insert(len(body) // 2, "moreover")
            filler = lambda n: [rng.choice(words) for _ in range(n)]
            if kind == 5:  # windows scattered
                parts = [body[k : k + 5] for k in range(len(body) - 4)]
                rng.shuffle(parts)
                body = [x for part in parts for x in (*part, *filler(50))]
            docs.append((len(docs), " ".join([*filler(20), *body, *filler(20)])))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    want = {(d, i) for d, text in docs for i, item in items.items() if holds(text, " ".join(item))}
    assert got == want and 40 < len(want) < 160


def test_an_item_without_an_id_is_looked_for(spark):
    text = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(1, f"and so {text} it was"), (2, "nothing of the sort")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, None)]


def test_items_of_slots_alone_match_as_they_are(spark):
    """Runs of numbers or names fit many texts, so they must be found word for word."""
    bench = spark.createDataFrame([(1, "12 15 18 21 24"), (2, "Alice Bob Carol David Erin"), (3, "Add 3 4 5 6 7 8 and then divide"), (4, "If Tom has 12 apples and buys 15 more how many apples has Tom")], "item_id long, text string")
    docs = [
        (10, "it measured 7 9 31 44 58 in the second trial"), (11, "present were Frank Grace Heidi Ivan Judy and others"), (12, "the row 12, 15, 18, 21, 24 goes on"), (13, "with Alice Bob Carol David Erin at home"),
        (14, "counts of 1 2 3 4 5 6 7 and then"), (15, "Add 3 4 5 6 7 8 and then divide"), (16, "If Ann has 7 apples and buys 9 more how many apples has Ann"), (17, "if alice bob carol david erin come"),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (10**6, 0):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, most_sent=most).collect()}
        assert got == {(12, 1), (13, 2), (17, 2), (15, 3), (16, 4)}


def test_a_line_of_very_many_documents_is_split(spark):
    """The join that marks lines is dealt anew where one line has most rows: nothing behind it needs them together."""
    from pyspark.sql import functions as F

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same line\n"), F.col("id").cast("string"), F.lit(" own\n"), (F.col("id") % 50).cast("string"))).toDF("doc_id", "text").repartition(12)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = linededup.drop_shared_lines(docs, min_docs=10)
        rows = out.select("doc_id", "text", "n_dropped")
        assert {r["text"] for r in rows.collect() if r["doc_id"] < 3} == {"0 own", "1 own", "2 own"}
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

