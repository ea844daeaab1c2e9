import random

from pyspark.sql import functions as F

from mentionflow.llm import quality_rules as q
from mentionflow.llm.queries import QUERIES
from tests.llm import brute

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_equal_brute_force_on_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op5_quality_rules"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for row in got:
        assert tuple(row[c] for c in COUNTS) == brute.quality(texts[row.doc_id]), row.doc_id


def test_counts_on_odd_texts(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "\x0b\x0ca b", "é#\n\né#\n \n", "x " * 30, "w " * 20_000, "a\n" * 50]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [" \n".join(rng.choice(["aa", "b|", "c"]) for _ in range(40)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "x"), (0, None)], "doc_id long, text string")
    for row in q.quality_scored(df).collect():
        assert tuple(row.quality[c] for c in COUNTS) == brute.quality(row.text), row.text


def test_rules_are_compiled_from_the_table(spark):
    clean = " ".join(f"word{i} of the house" for i in range(30))
    junk = " ".join(f"{w}###" for w in clean.split())
    df = spark.createDataFrame([(1, clean, 7), (2, junk, 8), (3, "of " * 3, 9)], "doc_id long, text string, quality long")
    got = {r.doc_id: r.quality for r in q.quality_scored(df).collect()}
    assert got[1].kept and got[1].failed == []
    assert not got[2].kept and "symbol_ratio" in got[2].failed and not got[2].base_failed
    assert got[3].base_failed and not got[3].kept
    strict = q.quality_scored(df, rules=[q.Rule("mean_word_length", most=1.0)]).filter("quality.kept")
    assert strict.count() == 0
    kept = q.quality_kept(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]


CLEAN = {
    "ru": "Старый дом стоял на берегу реки и каждый вечер его окна светились тёплым светом а соседи приходили пить чай и говорить о погоде",
    "el": "Το παλιό σπίτι στεκόταν στην όχθη του ποταμού και κάθε βράδυ τα παράθυρα φώτιζαν ενώ οι γείτονες έρχονταν για τσάι και κουβέντα εκεί",
    "ar": "كان البيت القديم يقف على ضفة النهر وفي كل مساء كانت نوافذه تضيء بنور دافئ وكان الجيران يأتون لشرب الشاي والحديث عن الطقس",
    "ko": "오래된 집은 강가에 서 있었고 매일 저녁 창문은 따뜻한 빛으로 빛났으며 이웃들은 차를 마시고 날씨에 대해 이야기하러 찾아왔다 그리고 아이들은 마당에서 늦게까지 놀았다",
    "hi": "पुराना घर नदी के किनारे खड़ा था और हर शाम उसकी खिड़कियाँ गर्म रोशनी से चमकती थीं और पड़ोसी चाय पीने आते थे",
    "zh": " ".join(["古老的房子矗立在河岸边每天傍晚窗户都透出温暖的灯光", "邻居们来喝茶聊天谈论天气和收成直到夜深"] + [f"第{x}个孩子在院子里玩耍直到天黑才回家吃饭" for x in "一二三四五六七八九十甲乙丙丁戊己庚辛"]),
}


def test_clean_texts_of_other_scripts_stay(spark):
    latin = "zorb quix vant plim " * 2 + " ".join(f"blorp{i} krandt{i}" for i in range(20))  # no word of any language
    rows = [*CLEAN.items(), ("none", latin), ("mixed", latin + " дом река"), ("junk", " ".join(f"дом{i}###" for i in range(40)))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.quality for r in q.quality_scored(df).collect()}
    assert [(x, got[x].failed, got[x].base_failed) for x in CLEAN] == [(x, [], False) for x in CLEAN]
    assert got["none"].failed == got["mixed"].failed == ["stop_word_ratio"]
    assert "symbol_ratio" in got["junk"].failed and not got["junk"].kept


def test_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = QUERIES["op5_quality_rules"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    good, lost, bad, caught = rows.filter("n_words >= 20").agg(
        F.sum(F.expr("int(quality = 1)")), F.sum(F.expr("int(quality = 1 and not kept)")),
        F.sum(F.expr("int(quality = 0)")), F.sum(F.expr("int(quality = 0 and not kept)")),
    ).first()
    assert lost <= 0.01 * good and caught >= 0.95 * bad


def test_empty_table_and_plan(spark, sf_dir):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert q.quality_scored(empty).count() == 0
    plan = QUERIES["op5_quality_rules"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_a_filter_stays_above_the_steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = q.quality_kept(docs)._jdf.queryExecution().optimizedPlan().toString()
    condition = next(line for line in plan.split("\n") if "Filter" in line)
    assert "lambda" not in condition
    assert "lambda" in plan[plan.index(condition) + len(condition) :]  # the steps are below it
