from pyspark.sql import functions as F

from resolvent.functions import formula, ids, names, variants, verdict
from resolvent.gold import GOLD, SPELLINGS


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r.y for r in df.select("k", expr(F.col("x")).alias("y")).orderBy("k").collect()]


def test_normalize(spark):
    got = ["  D-Glucose ", "TMAO(trimethylamine N-oxide)", "2-PG/3-PG", "Creatine monohydrate", "Butyryl carnitine", "α-Ketoglutaric acid", "4-(Dimethylamino)benzoic acid", "Tri(butoxyethyl) phosphate", "x ", None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(got)], "k int, x string")
    rows = names.normalized(df, "x", "n").withColumn("locant", names.has_locant(F.col("x"))).orderBy("k").collect()
    got = [r.n for r in rows]
    assert [bool(r.locant) for r in rows] == ["has_digit_locant" in r.n.flags for r in rows]
    assert [g.normalized for g in got[:8]] == ["D-Glucose", "trimethylamine N-oxide", "2-PG/3-PG", "Creatine", "Butyryl carnitine", "alpha-Ketoglutaric acid", "4-(Dimethylamino)benzoic acid", "Tri(butoxyethyl) phosphate"]
    assert got[1].parenthetical == "trimethylamine N-oxide" and got[1].alternatives == ["TMAO", "TMAO(trimethylamine N-oxide)"]
    assert got[2].alternatives == ["2-PG", "3-PG"] and got[2].flags == ["combined_name", "has_digit_locant"]
    assert got[3].flags == ["salt_stripped"] and got[4].alternatives == ["Butyrylcarnitine"]
    assert got[6].normalized.startswith("4-(") and got[8].normalized == "x"


def test_ids(spark):
    assert column(spark, ["HMDB00349", "hmdb0000349", "HMDB123456789", "C00031", None], ids.pad_hmdb) == ["HMDB0000349", "HMDB0000349", "HMDB123456789", "C00031", None]
    df = spark.createDataFrame([("MAM01234c", "c"), ("tdchola_c", "c"), ("met__L_c", "c"), ("glc__D_ex", ""), ("MAM01234c", ""), ("c", "c")], "s string, c string")
    assert [r.b for r in df.select(ids.base_id(F.col("s"), F.col("c")).alias("b")).collect()] == ["MAM01234", "tdchola", "met__L", "glc__D", "MAM01234", ""]
    assert column(spark, ["tdchola_", "ok", "__", "a-_"], ids.repaired) == ["tdchola", None, None, "a"]
    assert column(spark, [7, 12345], ids.feature_id, "long") == ["M0007", "M12345"]
    assert column(spark, [["HMDB1", " HMDB0000001", "", "NA"]], lambda x: ids.canonical_list(F.lit("hmdb"), x), "array<string>") == [["HMDB0000001"]]
    assert column(spark, [{"a": ["1", "2"], "b": ["1"]}], ids.ambiguous, "map<string, array<string>>") == [{"a": ["1", "2"]}]


def test_canonical_in_steps(spark):
    raw = ["HMDB00349", " hmdb0000349", "HMDB123456789", "CHEBI:5", "chebi:5", "5", " 7 ", "", "NA", "null", None, "C00031", "HMDBx"]
    df = spark.createDataFrame([(d, r) for d in ("kegg", "hmdb", "chebi", None) for r in raw], "db string, r string").withColumn("want", ids.canonical(F.col("db"), F.col("r")))
    got = ids.with_canonical(df, "db", "r", "id")
    assert got.columns == ["db", "r", "want", "id"] and [r.id for r in got.collect()] == [r.want for r in got.collect()]


def test_similarity(spark):
    assert column(spark, ["ab", "", "a-b c"], names.grams) == [[], [], ["abc"]]
    df = spark.createDataFrame([("Chenodeoxyglycocholate", "Glycochenodeoxycholic acid"), ("ab", "ab"), ("abc", "abc")], "a string, b string")
    got = [round(r.d, 4) for r in df.select(names.dice(names.grams(F.col("a")), names.grams(F.col("b"))).alias("d")).collect()]
    assert got[0] > 0.5 and got[1:] == [0.0, 1.0]
    s = spark.createDataFrame([("Glucose", "glucose", "B1"), ("glucose", "D-Glucose", "B1"), ("b1", "x", "B1"), ("zz", "qq", "B1")], "q string, n string, b string").select(names.name_score(names.name_parts(F.col("q")), names.name_parts(F.col("n")), F.col("b"), F.lit("b1_c b1_m")).alias("s")).collect()
    assert [(round(r.s.score, 2), r.s.kind) for r in s] == [(100.0, "name-exact"), (90.91, "name-trigram"), (96.0, "id-exact"), (0.0, "id-exact")]


def test_contaminants(spark):
    assert column(spark, ["Diethyl phthalate", "Tris(2-butoxyethyl) phosphate", "4-Nitrophenol", "Glucose", None], names.contaminant_tags) == [["plasticizer"], ["plasticizer/flame-retardant"], ["industrial-antioxidant"], [], []]
    assert column(spark, ["Lauryl sulfate", "Glucose"], names.contaminant_origin) == ["surfactant", None]


def test_formulas(spark):
    assert column(spark, ["C2H7NO3S", "HO4C4H5", "C6H12O6", "RCO2", "c5h11", None], formula.canonical) == ["C2H7NO3S", "C4H6O4", "C6H12O6", "RCO2", "C5H11", None]
    m = column(spark, ["C2H7NO3S", "RCO2", None], formula.mono_mass)
    assert round(m[0], 5) == 125.01466 and m[1:] == [None, None]
    assert column(spark, ["RCO2", "RbCl", "XeF2", "C2X"], formula.is_pool) == [True, False, False, True]
    assert column(spark, ["HCl", "H2O", "NaCl", "C2H7NO3S"], formula.canonical) == ["ClH", "H2O", "ClNa", "C2H7NO3S"]
    assert [round(x, 3) for x in column(spark, ["H2O", "C2H7NO3S"], formula.average_mass)] == [18.015, 125.147]
    v = column(spark, [125.01466, 126.0], lambda x: formula.verify(F.lit("C2H7NO3S"), F.lit("C2H7NO3S"), x), "double")
    assert [(r.formula_match, r.mass_match) for r in v] == [(True, True), (True, False)]
    n = column(spark, [181.0707], lambda x: formula.neutral_masses(x, ["[M+H]+", "nonsense"]), "double")[0]
    assert [(r.adduct, r.neutral_mono_mass) for r in n] == [("[M+H]+", 180.06342)]


def test_verdicts(spark):
    df = spark.createDataFrame(GOLD, "q string, c string, want string").withColumn("a", verdict.features(F.col("q"))).withColumn("b", verdict.features(F.col("c")))
    got = df.select("q", "c", "want", verdict.compare(F.col("a"), F.col("b")).alias("v")).collect()
    assert [(r.q, r.c, r.v.verdict) for r in got] == [(r.q, r.c, r.want) for r in got]
    axes = {(r.q, r.c): r.v.conflicts for r in got}
    assert "skeleton" in axes["Taurochenodeoxycholic acid", "Urocortisol"] and axes["LysoPC(P-16:0)", "1-Acyl-sn-glycero-3-phosphocholine"] == ["ether_linkage"]
    assert column(spark, [["ok", "conflict"], ["ambiguous", "ok"], []], verdict.best_of, "array<string>") == ["conflict", "ok", "unknown"]


def test_features(spark):
    f = column(spark, ["1-(8,11,14,17-eicosatetraenoyl)-glycero-3-phosphocholine", "1-linoleoyl-glycero-3-phosphocholine", "5,15-DiHETE", None], verdict.features)
    assert f[0].chains == ["20:4"] and f[0].db_positions == [8, 11, 14, 17]
    assert f[1].chains == ["18:2"] and f[1].omega == "n-6" and f[1].ether_linkage == ["acyl"]
    assert f[2].hydroxy_count == "2" and f[2].oxidation and f[3].chains == []


def test_variants(spark):
    assert "1-palmitoyl-sn-glycero-3-phosphocholine" in variants.variants("LysoPC(16:0)")
    assert variants.variants("15-HETE")[0] == "15-hydroxyeicosatetraenoic acid"
    assert "chenodeoxyglycocholate" in variants.variants("Glycochenodeoxycholic acid")
    assert "lactoneotetraosylceramide" in variants.variants("nLc4Cer") and "plasmenylcholine" in variants.variants("LysoPC(P-16:0)")
    assert not any("oleoyl" in v for v in variants.variants("Cer(d18:1/16:0)")) and variants.variants(None) == []
    assert all(variants.variants(n) == found for n, found in SPELLINGS.items())
    assert max(len(variants.variants(n)) for n in ("LysoPC(16:0)", "PC(16:0/18:1)")) <= variants.MOST
    assert variants.variants("3'-sialyl-neolactotetraosylceramide")[0] == "Sialyl-3-paragloboside" and variants.variants("oxidized LPC") == ["oxidized lysophosphatidylcholine", "oxidized phosphatidylcholine"]
    assert variants.variants("LysoPS(18:0)")[:3] == ["1-stearoyl-sn-glycero-3-phosphoserine", "1-stearoylglycero-3-phosphoserine", "stearoyl lysophosphatidylserine"]
    assert variants.variants("N1,N12-Diacetylspermidine") == ["diacetylspermine", "N1,N12-diacetylspermine"] and variants.variants("LPS(18:0)") == ["LPS"]
    assert variants.variants("LysoPC(O-16:0)")[0] == "1-hexadecyl-sn-glycero-3-phosphocholine" and "1-alkyl-sn-glycero-3-phosphocholine" in variants.variants("LysoPC(O-16:0)")
    assert variants.variants("Lac Cer") == variants.variants("LacCer")
    df = spark.createDataFrame([("15-HETE",), (None,)], "n string")
    assert variants.expand(df, "n").count() == len(variants.variants("15-HETE"))
