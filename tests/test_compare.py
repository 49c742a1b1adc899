"""Golden table: the six rows of the original comparison file, re-typed."""

from pixelmill.operators import compare as C

# fixed values: plain numbers of the original result file
ROWS = [
    (1, "Logistic Regression", "Spark MLlib", 0.9068767908309456, 0.9068280281156372, 0.966699507389164, 81.18108),
    (2, "Random Forest", "Spark MLlib", 0.9412607449856734, 0.9412531486907244, 0.9854679802955668, 13.933387),
    (3, "Linear SVM", "Spark MLlib", 0.8667621776504298, 0.8667230572410219, 0.9353530377668308, 11.118534),
    (4, "Logistic Regression", "scikit-learn", 0.9197707736389685, 0.919723322951848, 0.9738423645320197, 2.497544),
    (5, "Random Forest", "scikit-learn", 0.9441260744985673, 0.9441243542245857, 0.9878489326765189, 9.108291),
    (6, "SVM", "scikit-learn", 0.9498567335243553, 0.9498531311229245, 0.9826683087027914, 8.19904),
]
SCHEMA = "position int, Model string, Framework string, Accuracy double, `F1-Score` double, `AUC-ROC` double, `Training Time` double"


def _comp(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def test_best_model_and_time(spark):
    comp = _comp(spark)
    b = C.best_by(comp, "F1-Score").collect()[0]
    assert (b["Model"], b["Framework"]) == ("SVM", "scikit-learn")
    a = C.best_by(comp, "Accuracy").collect()[0]
    assert a["Model"] == "SVM"
    t = C.framework_time(comp).collect()[0]
    assert abs(t["avg_time_a"] - 35.411000333) < 1e-6 and abs(t["avg_time_b"] - 6.601625) < 1e-6
    assert t["faster"] == "scikit-learn" and f"{t['gap']:.2f}" == "28.81"


def test_insights_text(spark):
    rows = {r["rank"]: r["text"] for r in C.insights(_comp(spark)).collect()}
    assert rows[1] == "SVM (scikit-learn) avec un F1-Score de 94.99%"
    assert rows[2] == "scikit-learn est plus rapide de 28.81 secondes en moyenne"
    assert rows[3] == "SVM atteint 94.99% d'accuracy"


def test_tie_first_row_wins_and_one_framework(spark):
    tie = [(1, "A", "Spark MLlib", 0.9, 0.8, 0.7, 1.0), (2, "B", "Spark MLlib", 0.9, 0.8, 0.7, 2.0)]
    comp = _comp(spark, tie)
    assert C.best_by(comp, "F1-Score").collect()[0]["Model"] == "A"
    assert C.framework_time(comp).count() == 0
    assert C.insights(comp).count() == 2


def test_pivot_and_duplicates(spark):
    p = C.metric_pivot(_comp(spark)).where("Model = 'Random Forest' AND metric = 'Accuracy'").collect()[0]
    assert p["Spark MLlib"] == ROWS[1][3] and p["scikit-learn"] == ROWS[4][3]
    dup = _comp(spark, ROWS + [ROWS[0]])
    try:
        C.metric_pivot(dup).collect()
        raise AssertionError("duplicate not detected")
    except Exception as e:  # noqa: BLE001
        assert "duplicate" in str(e)


def test_display_name(spark):
    df = spark.createDataFrame([("spark_logistic_regression",), ("svm",), ("spark_random_forest",)], "n string")
    out = [r[0] for r in df.select(C.display_name("n")).collect()]
    assert out == ["Logistic Regression", "Svm", "Random Forest"]


def test_unknown_models_with_known_and_null_names(spark):
    req = spark.createDataFrame([(1, "svm"), (2, None), (3, "other")], "id int, model string")
    cat = spark.createDataFrame([("svm",), ("lr",)], "name string")
    rows = {r["id"]: r for r in C.unknown_model_rejects(req, "model", cat).collect()}
    assert set(rows) == {2, 3} and rows[3]["available_models"] == "lr,svm"
    assert rows[3]["reason"] == "Modèle other non disponible" and rows[2]["reason"] == "Modèle non spécifié"


def test_several_best_rows_and_empty_table(spark):
    both = {r["criterion"]: r["Model"] for r in C.best_by(_comp(spark), "F1-Score", "Training Time").collect()}
    assert both == {"F1-Score": "SVM", "Training Time": "Logistic Regression"}
    assert C.best_by(_comp(spark, []), "F1-Score").count() == 0 and C.insights(_comp(spark, [])).count() == 0
