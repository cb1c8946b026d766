"""Cases in which an operator once did less than its whole job."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from credsieve.llm import chat, decontaminate, language, near_duplicates, privacy, shards, token_files
from credsieve.session import fresh_path

DOCS = "doc_id long, text string, lang string"


def made_languages(rng, names):
    """{name: words} with letters and endings of their own, and words that all share."""
    common = ["radio", "metro", "de", "la", "in", "on"]
    out = {}
    for name in names:
        letters = rng.permutation(list("abcdefghijklmnopqrstuvwxyz"))[:14]
        out[name] = common + ["".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(600)]
    return out


def made_texts(rng, words, n):
    weights = 1 / np.arange(1, len(words) + 1)
    return [" ".join(rng.choice(words, 60, p=weights / weights.sum())) for _ in range(n)]


def test_labels_with_few_rows_do_not_win_or_hide_the_others(spark):
    rng = np.random.default_rng(11)
    known = made_languages(rng, ["l0", "l1", "l2", "l3"])
    rows = [(t, name) for name, words in known.items() for t in made_texts(rng, words, 400)]
    # Labels of one or two rows, beside the others, in texts of a language of their own.
    for i, words in enumerate(made_languages(rng, [f"rare{i}" for i in range(40)]).values()):
        rows += [(t, f"rare{i}") for t in made_texts(rng, words, 1 + i % 2)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS)
    model = language.fit(docs, sample_rows=200)
    truth = dict(enumerate(name for _, name in rows))
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    large = [i for i, name in truth.items() if name in known]
    assert sum(got[i] == truth[i] for i in large) >= 0.99 * len(large)
    kept = {r["doc_id"] for r in language.accepted(docs, model).collect()}
    assert sum(i in kept for i in large) >= 0.99 * len(large)
    # Rows that were learned from name their label, so each label was learned.
    learned = [r["doc_id"] for r in docs.where(~language.held_out(F.col("doc_id"))).collect() if r["lang"] not in known]
    assert learned and all(got[i] == truth[i] for i in learned)


def test_recognition_does_not_fall_with_the_number_of_labels(spark):
    rng = np.random.default_rng(12)
    known = made_languages(rng, [f"l{i:03}" for i in range(300)])
    rows = [(t, name) for name, words in known.items() for t in made_texts(rng, words, 8)]
    # Two names of one language.
    rows = [(t, "copy" if name == "l000" and i % 2 else name) for i, (t, name) in enumerate(rows)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS)
    model = language.fit(docs, words=6000, grams=12_000)
    assert len(model.languages) == 301
    assert language.accepted(docs, model).count() >= 0.99 * len(rows)
    strange = spark.createDataFrame([(1, "日本 中国 語学 文字", None), (2, "ζψ ωφ λμ", None), (3, "12 !", None)], DOCS)
    assert language.accepted(strange, model).count() == 0


def test_trees_find_a_pair_at_the_threshold_at_any_depth():
    rng = np.random.default_rng(13)
    n = 3000
    one = rng.integers(0, 1 << 16, (n, near_duplicates.FUNCTIONS)).astype(np.uint16)
    two = np.where(rng.random(one.shape) < 0.75, one, rng.integers(0, 1 << 16, one.shape).astype(np.uint16))
    # Signatures of pairs that agree too seldom are not compared wherever they meet.
    plausible = (one == two).sum(axis=1) >= near_duplicates.LEAST_AGREEING

    cids = pa.array([i.to_bytes(4, "big") for i in range(2 * n)], pa.binary())
    sigs = pa.array([s.tobytes() for s in np.concatenate([one, two])], pa.binary())
    sizes = pa.array([1] * (2 * n), pa.int64())
    down = next(near_duplicates._roots([pa.record_batch([cids, sigs, sizes], ["cid", "sig", "size"])]))
    for depth in range(near_duplicates.FIRST_DEPTH, near_duplicates.LAST_DEPTH + 1):
        held = set(zip(down.column(0).to_pylist(), (int.from_bytes(c, "big") for c in down.column(1).to_pylist())))
        common = [(node, i) for node, i in held if i < n and (node, i + n) in held]
        # A node goes deeper only as long as it is common; the chance of a common one must not fall.
        met = {i for _, i in common}
        assert sum(plausible[i] and i not in met for i in range(n)) <= 0.006 * n, depth
        nodes = pa.array([node for node, _ in common] * 2, pa.int64())
        own = pa.array([i for _, i in common] + [i + n for _, i in common])
        down = next(near_duplicates._deeper([pa.record_batch([nodes, cids.take(own), sizes.take(own), sigs.take(own)], ["node", "cid", "size", "sig"])]))


def test_a_term_far_from_the_value_is_masked_wherever_it_stands(spark):
    filler = "many plain words that all the pages share stand here between the one and the other "
    rows = [(i, f"Zephyrine\n{filler * 3}Write to zed@mail.example for more of it. {filler}So said Zephyrine.") for i in range(1)]
    rows += [(i, f"Zephyrine {i}\n{filler * (3 + i)}Write to zed@mail.example for more of it. {filler}So said zephyrine.") for i in range(1, 4)]
    rows += [(100 + i, f"{filler * (1 + i % 3)}Write to us for more of it. So said page {i}.") for i in range(300)]
    # Two texts are not enough evidence.
    rows += [(500 + i, f"Quillfeather {i}. {filler}Mail to two@mail.example.") for i in range(2)]
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("zephyrine" not in clean[i].lower() and "[EMAIL]" in clean[i] and "plain words" in clean[i] for i in range(4))
    assert all("Quillfeather" in clean[500 + i] for i in range(2)) and clean[100] == dict(rows)[100]


def test_wordless_texts_of_one_id_all_stay(spark):
    rows = [(1, None), (1, ""), (1, " "), (1, " "), (None, "\t"), (None, "\n"), (2, "a b c"), (2, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), (F.trim(F.coalesce("text", F.lit(""))).rlike("[a-z]")).alias("w"))
    found = parts.selectExpr("doc_id", "text_key", "if(w, 1L, 0L) as n_shingles", "doc_id as component_id", "if(w, 'c', 'none') as component")
    kept = [(r["doc_id"], r["text"]) for r in near_duplicates.kept_rows(docs, found).collect()]
    assert sorted(kept, key=str) == sorted(set(rows), key=str)


def test_a_node_s_links_are_exact_and_as_few_as_join_its_groups():
    rng = np.random.default_rng(5)
    for _ in range(150):
        base = [np.unique(rng.integers(0, 1 << 62, rng.integers(1, 60)).astype(np.uint64)) for _ in range(6)]
        sets = []
        for _ in range(int(rng.integers(2, 30))):
            own = base[rng.integers(6)]
            sets.append(np.unique(np.concatenate([own[rng.random(len(own)) < 0.93], rng.integers(0, 1 << 62, rng.integers(0, 4)).astype(np.uint64), own[:1]])))
        groups = [f"g{rng.integers(20)}" for _ in sets]
        links = near_duplicates.spanning_links(sets, groups)

        def joined(pairs):
            parts = {g: {g} for g in groups}
            for a, b in pairs:
                if parts[a] is not parts[b]:
                    parts[a] |= parts[b]
                    for x in parts[b]:
                        parts[x] = parts[a]
            return {frozenset(p) for p in parts.values()}

        every = [(groups[i], groups[j]) for i in range(len(sets)) for j in range(i) if near_duplicates.linked(sets[i], sets[j])]
        assert joined((groups[a], groups[b]) for a, b in links) == joined(every)
        assert len(links) == len(set(groups)) - len(joined(every))
        assert all(near_duplicates.linked(sets[a], sets[b]) for a, b in links)


def test_ids_of_a_range_are_read_from_their_blocks(spark):
    rng = np.random.default_rng(9)
    for width in range(33):
        values = rng.integers(0, 1 << width, (3, 256)).astype(np.uint32) if width else np.zeros((3, 256), np.uint32)
        for block in (256, 100, 1):
            packed = token_files._pack(values[:, :block], width)
            assert packed.shape[1] == token_files._packed_size(width, block)
            assert (token_files._unpack(packed, width, block) == values[:, :block]).all()
    rows = [(i, " ".join(rng.choice(["some", "plain", "words", "Überzeile", "x9"], rng.integers(0, 900)))) for i in range(60)]
    path = fresh_path(spark, "token-files")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), path, segment_ids=3000)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    every = [x for _, t in rows for x in [*library.encode(t, add_special_tokens=False).ids, token_files.END_ID]]
    for first, last in ((0, 10), (2990, 3310), (len(every) - 5, len(every) + 9), (4000, 4000), (0, len(every))):
        got = sorted(token_files.ids_between(spark, path, first, last).collect())
        assert [x for r in got for x in r["ids"]] == every[first:last]


def test_only_items_whose_words_are_there_are_looked_for():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    items = decontaminate._items((i, " ".join(rng.choice(words, 20))) for i in range(40))
    terms = {w: i + 1 for i, w in enumerate(sorted({w for i in items for w in i.words}))}
    latent = rng.standard_normal((len(terms) + 1, 16)).astype(np.float32)
    latent[0] = 0
    search = decontaminate.Search(items, terms, latent, 0.0)
    texts = [" ".join(rng.choice(words, 60)) for _ in range(40)] + [" ".join(w.decode() for w in i.words) for i in items]
    def numbered(texts):
        return [search.terms.numbers(t) for t in texts]

    found = {(i, k) for i, k, *_ in search.matches(numbered(texts))}
    # Looking for rare words first loses none, whichever terms are rare.
    for share in (0.3, 0.7, 1.0):
        weights = np.where(rng.random(len(terms) + 1) < share, 9, 0)
        again = decontaminate.Search(items, terms, latent, 0.0, weights)
        long = [f"{' '.join(rng.choice(words, 400))} {t} {' '.join(rng.choice(words, 400))}" for t in texts]
        assert sorted(again.matches(numbered(texts + long))) == sorted(search.matches(numbered(texts + long)))
    for i, text in enumerate(texts):
        numbers = search.terms.numbers(text)
        there = set(numbers.tolist())
        want = {k for k, own in enumerate(search.numbers) if sum(n in there for n in own) >= decontaminate.MOST * len(own)}
        assert set(search.coverage.covered(numbers).tolist()) == want and {k for j, k in found if j == i} <= want
    assert {(40 + k, k) for k in range(40)} <= found


def test_a_word_that_folds_to_several_letters_is_counted_like_any_other(spark):
    rows = [(i, f"İstanbul is where page {i} was written, as all of them are.") for i in range(200)]
    rows += [(500 + i, f"İstanbul office {i}, write to desk@mail.example today.") for i in range(4)]
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("İstanbul" in clean[500 + i] and "[EMAIL]" in clean[500 + i] for i in range(4))


def test_written_shards_hold_every_row_once(spark):
    rows = [(1, "a"), (1, "a"), (1, "bb"), (None, "c"), (None, None), (2, "x" * 50), (2, "y" * 50), (2, "z" * 50)] + [(i, "text") for i in range(3, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as _key", "'s' as _shard", "1 as row")
    path = fresh_path(spark, "shards")
    shards.write_shards(docs, path, limit=60)
    back = spark.read.parquet(path)
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(rows, key=str)
    sizes = back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).collect()
    assert len(sizes) > 3 and max(r["n"] for r in sizes) <= 60


def test_rows_without_a_conversation_are_not_mixed(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "b"), (None, 1, "assistant", "c"), (5, 0, "user", "u"), (5, 1, "assistant", "v")]
    examples = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = sorted((r["conv_id"] or 0, r["n_turns"], r["loss_chars"]) for r in chat.read_back(examples).collect())
    assert back == [(0, 1, 0), (0, 1, 0), (0, 1, 1), (5, 2, 1)]
