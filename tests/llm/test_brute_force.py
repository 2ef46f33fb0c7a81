"""Operators against brute force on the small tables."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import common, decontaminate, exact_dedup, html_text, knn_quality, lbl_scoring, line_dedup, linking, minhash_dedup, registry, sharding, toxicity, wordhash
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), connect(sf), registry.SQL[name])


def shingles(text, size=5):
    w = text.lower().split()
    return collections.Counter(tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, min(len(w), 1))))


def test_near_duplicates_are_found(spark, texts):
    """Planted edits of every tenth word position in long texts, and edits too heavy to link."""
    rows, pairs = [], []
    for i, t in list(texts.items())[:80]:
        w = t.split()
        if len(w) < 120:
            continue
        light, heavy = list(w), list(w)
        light[len(w) // 2] = "changed"
        for k in range(0, len(w), 6):
            heavy[k] = f"other{k}"
        rows += [(i, t), (10_000 + i, " ".join(light)), (20_000 + i, " ".join(heavy))]
        pairs.append(i)
    assert len(pairs) > 20
    found = {r.doc_id: r.class_id for r in minhash_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for i in pairs:
        a, b = shingles(text[i]), shingles(text[10_000 + i])
        assert sum((a & b).values()) / sum((a | b).values()) > 0.85
        assert found[i] == found[10_000 + i]
        assert found[20_000 + i] != found[i]


def test_large_group_is_one_class(spark):
    """A third of all rows are near copies of one text."""
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base[: k % 180] + [f"edit{k}"] + base[k % 180 + 1 :])) for k in range(150)]
    rows += [(1000 + k, " ".join(f"v{k}x{j}" for j in range(100))) for k in range(300)]
    found = {r.doc_id: r.class_id for r in minhash_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[k] for k in range(150)} == {0}
    assert all(found[1000 + k] == 1000 + k for k in range(300))


def test_decontamination_finds_verbatim_and_edited_items(spark, texts):
    items = {k: " ".join(t.split()[3 : 3 + 50]) for k, t in list(texts.items())[:12] if len(t.split()) > 60}
    plain = "nothing of the kind occurs in here at all and so on and on"
    edited = {k: " ".join(["first", *t.split()[1:-1], "last"]) for k, t in items.items()}
    docs = [(k, f"{plain} {re.sub("[a-z]", lambda m: m[0].upper(), t)}, {plain}") for k, t in items.items()] + [(100 + k, f"{plain} {t} {plain}") for k, t in edited.items()]
    docs += [(200 + k, " ".join(t.split()[:20]) + " " + plain) for k, t in items.items()]
    found = {r.doc_id: r for r in decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    for k in items:
        assert k in found[k].item_ids and k in found[100 + k].item_ids and k not in found[200 + k].item_ids


def scanned(spark, docs, items):
    return {r.doc_id: r for r in decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_decontamination_finds_an_item_out_of_order(spark):
    item = [f"word{k}" for k in range(50)]
    swapped = item[25:] + item[:25]
    around = [f"other{k}" for k in range(80)]
    docs = [(1, " ".join(around + swapped + around)), (2, " ".join(swapped)), (3, " ".join(around + item[:25] + around + item[25:]))]
    found = scanned(spark, docs, [(7, " ".join(item))])
    assert found[1].item_ids == [7] and found[2].item_ids == [7] and not found[3].contaminated
    assert found[1].best_similarity == pytest.approx(42 / 50)


def test_decontamination_does_not_depend_on_the_fingerprint(spark, monkeypatch):
    """No window within the radius, and the items are found all the same; a radius of 1 stands for edits far beyond it."""
    monkeypatch.setattr(decontaminate, "RADIUS", 1)
    items = {k: [f"i{k}w{j}" for j in range(60)] for k in range(8)}
    docs = [(k, " ".join(["before"] * 9 + t[:-5] + [f"x{j}" for j in range(40)])) for k, t in items.items()]
    found = scanned(spark, docs, [(k, " ".join(t)) for k, t in items.items()])
    for k in items:
        assert found[k].item_ids == [k] and found[k].best_similarity == pytest.approx(51 / 61)


def test_decontamination_finds_short_items_in_longer_texts(spark):
    docs = [(1, "one of a kind: Tiny item, here and there"), (2, "at the very end of it a tiny item"), (3, "a tiny"), (4, "the tiny item"), (5, "tiny little item in the middle of it"), (6, "你好，世界 and more of it all, really"), (7, "tiny item")]
    found = scanned(spark, docs, [(8, "tiny item"), (9, "你好")])
    assert {k: r.item_ids for k, r in found.items()} == {1: [8], 2: [8], 3: [], 4: [8], 5: [], 6: [9], 7: [8]}


def test_base_score_is_exact(spark, sf, texts):
    out = {r.doc_id: r for r in registry.QUERIES["op5_lm_scoring"](spark, sf).collect()}
    tokens = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w] + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = collections.Counter(w for i in texts if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    gain = []
    for i, t in tokens.items():
        r = out[i]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        assert r.held_out == held[i] and r.n_tokens == len(t) and r.n_known == sum(counts[w] > 0 for w in t) and r.train_tokens == n
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if held[i]:
            gain.append((r.score - r.base_score) / r.n_tokens)
    assert np.mean(gain) > 0


def test_model_probabilities_sum_to_one():
    counts = lbl_scoring.Counts(1000, 50, 20, np.arange(40, dtype=np.uint64), np.arange(1, 41), np.arange(2, 42, dtype=np.int32), np.arange(512), np.arange(512))
    share = lbl_scoring.unigram(counts)
    windows = np.random.default_rng(1).integers(0, 42, (5000, 3)).astype(np.int16)
    windows[windows == lbl_scoring.BEGIN] = lbl_scoring.END
    seen, p = lbl_scoring.train(iter([windows]), share, 3)
    t = lbl_scoring.normalised({k: v.astype(np.float64) for k, v in p.items()}, share)
    for a, b in ((0, 1), (5, 9), (2, 2)):
        assert np.exp(t.one[a].astype(float) + t.two[b] - t.norm[a, b]).sum() == pytest.approx(1, abs=1e-3)


def test_model_does_not_depend_on_partitions_or_order(documents, monkeypatch):
    """With several trainers, and with rows that lie otherwise."""
    monkeypatch.setattr(lbl_scoring, "WINDOWS", 6000)
    docs = documents.limit(120).cache()
    runs = [{r.doc_id: r.score for r in lbl_scoring.score(x).collect()} for x in (docs, docs.repartition(7), docs.orderBy(F.desc("doc_id")))]
    assert runs[0] and all(run[i] == pytest.approx(runs[0][i], rel=1e-9) for run in runs[1:] for i in runs[0])


def test_words_of_a_class_share_its_probability(documents):
    """Within each class the known words and one unseen word have shares that sum to one."""
    table = lbl_scoring.word_counts(documents).cache()
    counts = lbl_scoring.summarise(table)
    words = np.array([r.word for r in table.collect()], np.int64)
    times = {r.word: r["count"] for r in table.collect()}
    words = words[words != lbl_scoring.END_KEY.view(np.int64)].view(np.uint64)
    at, hit = lbl_scoring.look_up(words, counts)
    ids = lbl_scoring.model_ids(words, at, hit, counts)
    total = np.ones(lbl_scoring.CLASSES)
    inside = ids >= lbl_scoring.FIRST_CLASS
    np.add.at(total, ids[inside] - lbl_scoring.FIRST_CLASS, np.array([times[int(w)] for w in words[inside].view(np.int64)]) + 1)
    assert inside.any() and np.array_equal(total, counts.class_tokens + counts.class_types + 1)


def test_model_trains_on_every_position(documents):
    docs = documents.limit(20)
    counts = lbl_scoring.summarise(lbl_scoring.word_counts(docs))
    seen = sum(len(r.windows) // 6 for r in lbl_scoring.training_windows(docs, counts).select("windows").collect())
    assert seen == counts.tokens > 0


def test_lines_against_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old stone house"
    near = base.replace("stone", "stony")
    rows = [(1, f"{base}\nunrelated words stand here alone\n{near}"), (2, f"{near.upper()}\n\nanother line of a text"), (3, base[:40])]
    out = {(r.doc_id, r.line_no): r for r in line_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1, 0].class_id == out[1, 2].class_id == out[2, 0].class_id
    assert out[1, 0].kept and not out[1, 2].kept and not out[2, 0].kept and out[2, 2].kept and out[3, 0].kept


WIDE = "/root/testdata/sf0.01"


def brute_pairs(sets, most=400):
    """Pairs at 0.8 or more among multisets, of all that share an element that not too many have."""
    of = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            of[x].append(k)
    pairs = {(x, y) for members in of.values() if len(members) < most for a, x in enumerate(members) for y in members[a + 1 :]}
    out = []
    for a, b in pairs:
        n = sum((sets[a] & sets[b]).values())
        if n >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - n):
            out.append((a, b))
    return out


def test_near_duplicates_against_all_pairs(spark):
    docs = spark.read.parquet(f"{WIDE}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    links = [(rows[a][0], rows[b][0]) for a, b in brute_pairs([shingles(t) for _, t in rows])]
    found = {r.doc_id: r.class_id for r in minhash_dedup.classes(docs).collect()}
    assert len(links) > 50
    assert sum(found[a] == found[b] for a, b in links) >= 0.99 * len(links)
    # The idf moves a similarity a little, so classes may also hold pairs somewhat under the threshold, and none far from it.
    text = dict(rows)
    classes = collections.defaultdict(list)
    for i, c in found.items():
        classes[c].append(i)
    for members in classes.values():
        for i in members[1:]:
            assert max(sum((shingles(text[i]) & shingles(text[j])).values()) / max(sum((shingles(text[i]) | shingles(text[j])).values()), 1) for j in members if j != i) >= 0.75 or not text[i].split()


def test_decontamination_against_all_windows(spark):
    """Every window of an item's length, at every place where it shares a shingle with the item."""
    docs, items = spark.read.parquet(f"{WIDE}/documents.parquet"), spark.read.parquet(f"{WIDE}/benchmark.parquet")
    tokens = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: collections.Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1))))
    wanted = {r.item_id: tokens(r.text) for r in items.collect()}
    of = collections.defaultdict(set)
    for i, w in wanted.items():
        for g in grams(w):
            of[g].add(i)
    expected = {}
    for r in docs.collect():
        w = tokens(r.text)
        places = collections.defaultdict(set)
        for k in range(max(len(w) - 4, min(len(w), 1))):
            for i in of.get(tuple(w[k : k + 5]), ()):
                places[i].add(k)
        hits = set()
        for i, at in places.items():
            n, own = len(wanted[i]), grams(wanted[i])
            for start in {s for k in at for s in range(k - n, k + 1)}:
                window = grams(w[max(start, 0) : start + n])
                common = sum((window & own).values())
                if common >= 0.8 * (sum(window.values()) + sum(own.values()) - common) and common:
                    hits.add(i)
        expected[r.doc_id] = sorted(hits)
    found = {r.doc_id: r.item_ids for r in decontaminate.scan(docs, items).collect()}
    assert sum(map(bool, expected.values())) > 10
    assert found == expected


def test_shards_against_a_directory_split_bucket_by_bucket(spark, sf):
    import hashlib

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, len((r.text or "").encode()), bin(int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16))[2:].zfill(60)) for r in docs.collect()]
    buckets, leaves = {"": rows}, {}
    while buckets:
        prefix, own = buckets.popitem()
        if sum(n for _, n, _ in own) <= 20_000:
            leaves |= {i: (prefix, sum(n for _, n, _ in own)) for i, _, _ in own}
        else:
            for bit in "01":
                buckets[prefix + bit] = [x for x in own if x[2].startswith(prefix + bit)]
    out = {r.doc_id: (r.shard, r.shard_bytes) for r in sharding.shard(docs, limit=20_000).where("NOT oversize").collect()}
    assert len({s for s, _ in out.values()}) > 8
    assert out == {i: x for i, x in leaves.items() if i in out} and len(out) == len(rows)


def area(rows):
    """Area under the ROC curve of (label, score)."""
    good, bad = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize("module,column,modulus,fold,least", [(toxicity, "toxic", 5, 0, 0.75), (knn_quality, "quality", 4, 2, 0.95)])
def test_classifiers_on_held_out_labels(spark, module, column, modulus, fold, least):
    docs, labels = spark.read.parquet(f"{WIDE}/documents.parquet"), spark.read.parquet(f"{WIDE}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == fold
    other = labels.withColumn(column, F.when(held, 1 - F.col(column)).otherwise(F.col(column)))
    out, changed = ({r.doc_id: r for r in module.judge(docs, x).collect()} for x in (labels, other.repartition(3)))
    truth = {r.doc_id: r[column] for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == fold) for i, r in out.items())
    assert {i: r.score for i, r in out.items()} == {i: r.score for i, r in changed.items()}
    assert area([(truth[i], r.score) for i, r in out.items() if r.held_out and truth.get(i) is not None]) >= least


def line_shingles(line):
    raw = line.encode()
    return {raw[k : k + 8] for k in range(max(len(raw) - 7, 1))}


def test_line_links_are_found(spark):
    """Every pair of lines of the documents at 0.8 or more by brute force over all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = collections.defaultdict(list)
    for r in docs.collect():
        for n, line in enumerate((r.text or "").split("\n")):
            if line := re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" "):
                lines[re.sub("[A-Z]", lambda m: m[0].lower(), line)].append((r.doc_id, n))
    names = list(lines)
    of = collections.defaultdict(list)
    sets = [line_shingles(x) for x in names]
    for k, s in enumerate(sets):
        for x in s:
            of[x].append(k)
    common = collections.Counter()
    for members in of.values():
        if len(members) < 400:  # a pair at 0.8 shares rarer shingles too
            for a, x in enumerate(members):
                common.update((x, y) for y in members[a + 1 :])
    links = [(a, b) for (a, b) in common if (n := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    assert len(links) > 100
    out = line_dedup.classes(docs).collect()
    found = {(r.doc_id, r.line_no): r for r in out}
    assert len(out) == sum(map(len, lines.values())) == len(found)
    same = sum(found[lines[names[a]][0]].class_id == found[lines[names[b]][0]].class_id for a, b in links)
    assert same >= 0.99 * len(links)
    # No class holds lines that no links join, and each keeps its first line.
    parent = list(range(len(names)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[top(a)] = top(b)
    expected = collections.defaultdict(set)
    for k, x in enumerate(names):
        for place in lines[x]:
            expected[found[place].class_id].add(top(k))
    assert all(len(x) == 1 for x in expected.values())
    first = {}
    for r in out:
        first[r.class_id] = min(first.get(r.class_id, (r.doc_id, r.line_no)), (r.doc_id, r.line_no))
    assert all(r.kept == (first[r.class_id] == (r.doc_id, r.line_no)) for r in out)


def test_word_hashes_agree_with_python_words():
    texts = ["Hello  wOrld\n x", "", None, "éa Éa hello", " lead"]
    words = wordhash.Words.of(texts)
    expected = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert words.counts.tolist() == expected
    assert words.hash[0] == wordhash.hash_words(["hello"])[0] == words.hash[5]
    assert words.hash[3] != words.hash[4]


def test_main_text(spark, sf):
    for r in html_text.extract(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html", F.col("html").alias("raw"))).collect():
        article = re.search(r"<article>(.*?)</article>", r.raw, re.S)[1]
        import html as h

        blocks = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


PAGES = [
    (None, ""),
    ("", ""),
    ("plain words", "plain words"),
    ("<p>a &amp; b<p>c&nbsp;&eacute;<script>x='<p>no</p>'</script>", "a & b\nc é"),
    ("<body><header><p>Site name and a long motto, with commas, here</p></header><div class=content><h2>Title</h2><p>A long text, with commas, that tells a story of some length.</p><ul><li>point one</li></ul></div><div class='comments'><p>I liked this, and that, and more of it all.</p></div><form><p>Join us, now</p></form></body>",
     "Title\nA long text, with commas, that tells a story of some length.\npoint one"),
    ("<main><p>Kept text, first part.</p><aside><p>Related, links, here</p></aside><div role='alert'>Notice</div><p hidden>gone</p><p>Second part.</p></main><footer>foot</footer>", "Kept text, first part.\nSecond part."),
]


BODY = "".join(f"<p>Paragraph {k} of the story, long enough to count, with commas, and more of it to read.</p>" for k in range(4))
STORY = "\n".join(f"Paragraph {k} of the story, long enough to count, with commas, and more of it to read." for k in range(4))
CHROME = (
    "<nav><a href=/>Home</a></nav><div class='sidebar'><ul><li><a href=/a>First link here</a></li><li><a href=/b>Second link, here</a></li></ul></div>"
    "<div class='ad-box'><p>Buy now, cheap, good</p></div>{}<div id='cookie-notice'><p>We use cookies, to know you, better.</p></div>"
    "<div class='comment-body'><p>I read it all, twice, and I liked it, mostly, I think, so there.</p></div><div class='social-links'><a href=/x>Share</a> <a href=/y>Send</a></div>"
)
WRAPPERS = [
    "<div class='content no-sidebar'>{}</div>", "<div class='page has-sidebar'>{}</div>", "<div class='social-science'>{}</div>", "<div id='read-more-article'>{}</div>",
    "<div class='post tags-on'>{}</div>", "<form id='aspnetForm'><div class='content'>{}</div><input name=q><label>Search</label></form>",
    "<div class='post-content has-sidebar'>{}</div>", "<div class='story social-issues'>{}</div>", "<div>{}</div>", "<section><div><div>{}</div></div></section>", "<td>{}</td>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("page", ["{}", CHROME])
def test_names_do_not_decide_alone(wrapper, page):
    assert html_text.main_text("<body>" + page.format(wrapper.format(BODY)) + "</body>") == STORY


def test_scoring_finds_the_container_among_others():
    """No article tag, no telling names: commas, length and links decide, and a paragraph named like a link stays if it reads like one."""
    lists = "<div>" + "".join(f"<p><a href=/{k}>A headline of some length, number {k}</a></p>" for k in range(8)) + "</div>"
    html = f"<body><div>{lists}<div><h2>Title of it</h2>{BODY}<p class='read-more'>There is more to read, of course, and it goes on here.</p></div></div><div><p>Imprint</p></div></body>"
    assert html_text.main_text(html) == "Title of it\n" + STORY + "\nThere is more to read, of course, and it goes on here."


def test_remarks_longer_than_the_article_go():
    html = f"<body><div class='entry'>{BODY}</div><div id='comments'>" + BODY.replace("story", "remark") * 5 + "</div></body>"
    assert html_text.main_text(html) == STORY


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text_of_small_pages(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("held", [4_000_000, 7])
def test_buckets_hold_every_key_with_several_ids(spark, monkeypatch, held):
    """Also where a task must settle its rows many times, with pivots that change."""
    monkeypatch.setattr(linking, "HELD", held)
    random = np.random.default_rng(4)
    rows = [(int(k), int(i)) for k, i in zip(random.integers(0, 30, 300), random.integers(0, 200, 300), strict=True)]
    keys = collections.defaultdict(list)
    for k, i in rows:
        keys[i].append(k)
    members = spark.createDataFrame([(i, np.array(k, np.int64).tobytes()) for i, k in keys.items()], "id long, keys binary").repartition(3)
    expected = collections.defaultdict(set)
    for k, i in rows:
        expected[k].add(i)
    found, joined = collections.defaultdict(set), collections.defaultdict(dict)
    for r in linking.partition_buckets(members).collect():
        found[r.key].add(r.id)
        joined[r.key].setdefault(r.id, set()).add(r.pivot)
    assert found == {k: v for k, v in expected.items() if len(v) > 1}
    for k, pivots in joined.items():
        for i in pivots:  # every member leads to the smallest id
            while i != min(expected[k]):
                i = min(pivots[i] - {i})


@pytest.mark.parametrize("few", [1, 20, 1 << 8])
def test_even_join_keeps_every_row(spark, monkeypatch, few):
    """With a key that holds a third of all rows, a null key, repeated rows and a key that only one side has."""
    monkeypatch.setattr(common, "FEW", few)
    monkeypatch.setattr(common, "HEAVY", 16)
    keys = [7] * 500 + [None] * 300 + [3] * 25 + list(range(100, 600))
    rows = spark.createDataFrame([(k, i // 2) for i, k in enumerate(keys)], "key long, v long").repartition(5)
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    groups = groups.unionByName(spark.createDataFrame([(9, 0, 0)], groups.schema)).where("key IS NULL OR key <> 100")
    sums = collections.Counter()
    for i, k in enumerate(keys):
        sums[k] += i // 2
    found = common.even(rows, groups.drop("n"), "key", groups.select("key", "n"))
    assert found.columns == ["key", "v", "s"]
    expected = collections.Counter((k, i // 2, sums[k]) for i, k in enumerate(keys) if k != 100)
    assert collections.Counter(map(tuple, found.collect())) == expected


def test_large_groups_do_not_change_classes(spark, documents, monkeypatch):
    """Classes, sizes and verdicts are alike whether the rows of a group are dealt to several tasks or not."""
    rows = documents.select("doc_id", "text").unionByName(documents.where("doc_id < 5").select((F.col("doc_id") % 2 + 10_000).alias("doc_id"), "text"))

    def results():
        index = exact_dedup.new_index(spark)
        out = [sorted(map(tuple, x.collect()), key=str) for x in (
            minhash_dedup.sized(minhash_dedup.classes(rows).checkpoint()), line_dedup.classes(rows).select("doc_id", "line_no", "class_id"),
            exact_dedup.deduplicate(rows, index).select("doc_id", "keep_id", "group_size", "text_sha256"))]
        index.drop()
        return out

    common.shared_folder(spark)
    plain = results()
    monkeypatch.setattr(common, "FEW", 1)
    monkeypatch.setattr(common, "HEAVY", 64)
    assert results() == plain
