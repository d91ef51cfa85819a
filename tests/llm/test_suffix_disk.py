"""The second level of the suffix tree is joined once, part by part."""

from pyspark.sql import functions as F

from rankloom.llm import suffix_tree_lm as S


def test_no_table_repeats_the_joins_of_another(spark, monkeypatch):
    joins, write = [], S.written

    def counted(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df)

    monkeypatch.setattr(S, "written", counted)
    texts = [f"a b c{i % 3} a b c{i % 3} d e" for i in range(60)]
    model, tokens, words = S.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(True))
    assert tokens == 60 * 9 and words == 8 and model.where("not word").count() > 0
    assert 1 <= max(joins) <= 2
