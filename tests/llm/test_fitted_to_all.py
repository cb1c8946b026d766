"""Models that are fitted to every row, not to some of them."""

import inspect

from credsieve.llm import decontaminate, language


def test_every_labelled_row_counts(spark):
    # 30,000 rows, each with a word of its own pair: a model of some rows would lack most of them.
    n = 30_000
    def spelled(x):
        return "".join("abcdefghij"[int(d)] for d in f"{x:05d}")
    rows = [(2 * i + j, f"{spelled(i)} common", "aa" if i % 2 else "bb") for i in range(n // 2) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {text.split()[0] for (text,) in docs.where(~language.held_out(docs["doc_id"])).select("text").collect()}
    learned = docs.where(~language.held_out(docs["doc_id"])).groupBy("text").count().where("count > 1").count()
    model = language.fit(docs)
    assert len(model.words) == learned + 1 and set(model.words) <= kept | {"common"}


def test_the_decomposition_is_fitted_to_all_documents(spark, monkeypatch):
    assert "sample_rows" not in inspect.signature(decontaminate.searches).parameters
    benchmark = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    docs = spark.range(6_000).selectExpr("id as doc_id", "concat('w', id % 40, ' and w', (id + 1) % 40) as text")
    seen = []
    fitted = decontaminate._latent
    monkeypatch.setattr(decontaminate, "_latent", lambda read, *rest: seen.append(read.where("numbers is not null").count()) or fitted(read, *rest))
    assert [s for s, _ in decontaminate.searches(docs, benchmark)] and seen == [6_000]
