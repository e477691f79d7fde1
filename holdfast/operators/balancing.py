"""Class balancing by synthetic minority rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.plans.neighbours import nearest_points, weighted_points
from holdfast.plans.strata import stratum_rank
from holdfast.sources.tables import TableStore

NEIGHBOURS = 5
BALANCE_FEATURES = [
    "tenure", "monthly_charges", "total_charges", "senior_citizen", "charge_per_month", "services_count", "contract_risk_score", "payment_risk_score",
]


def _uniform(*parts: Column) -> Column:
    """Reproducible number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def smote(df: DataFrame, store: TableStore, run_id: str, features: list[str] = BALANCE_FEATURES, label: str = "churn_label", key: str = "customer_id", k: int = NEIGHBOURS, seed: int = 42, cell_rows: int | None = None) -> DataFrame:
    """The rows of `df` and as many synthetic rows of the smaller class as make both classes equal.

    A synthetic row lies on the line from a row to one of its k nearest neighbours of the same
    class; neighbour and place on the line follow from hashes of key and seed. Copies of a row are
    its nearest neighbours, at distance 0. The distinct minority points are stored under `run_id`.
    """
    sizes = {r[label]: r.n for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two classes
    if len(sizes) != 2:
        raise ValueError(f"expected two classes, found {sorted(sizes)}")
    minor, major = sorted(sizes, key=lambda c: (sizes[c], c))
    n, wanted = sizes[minor], sizes[major] - sizes[minor]
    if n <= k:
        raise ValueError(f"{n} rows of class {minor} are too few for {k} neighbours")

    base = df.select(key, label, *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    minority = base.where(F.col(label) == minor)
    store.write("smote_points", weighted_points(minority, features), run_id)
    points = store.snapshot("smote_points")
    options = {} if cell_rows is None else {"cell_rows": cell_rows}
    near = nearest_points(points, len(features), k, **options)

    # the k neighbours of a row, counting copies: first its own copies, then the others with theirs
    copies = F.array_repeat(F.col("v"), F.least(F.col("m") - 1, F.lit(k)).cast("int"))
    others = F.flatten(F.transform(F.coalesce("near", F.array()), lambda p: F.array_repeat(p["v"], F.least(p["m"], F.lit(k)).cast("int"))))
    choices = near.select("v", F.slice(F.concat(copies, others), 1, k).alias("choices"))

    whole, rest = divmod(wanted, n)
    ranked = stratum_rank(minority, label, key, seed, name="_rank")
    times = F.lit(whole) + (F.col("_rank") <= rest).cast("int")
    vector = F.array(*[F.col(f"`{f}`") for f in features])
    seeds = ranked.select(key, label, vector.alias("v"), times.alias("times")).where("times > 0").join(choices, "v")
    drawn = seeds.select(key, label, "v", "choices", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("i"))
    pick = F.floor(_uniform(F.col(key), F.col("i"), F.lit(seed)) * F.size("choices")).cast("int")
    drawn = drawn.withColumns({"to": F.get("choices", pick), "t": _uniform(F.col("i"), F.col(key), F.lit(seed + 1))})
    mixed = [(F.col("v")[j] + F.col("t") * (F.col("to")[j] - F.col("v")[j])).alias(f) for j, f in enumerate(features)]
    synthetic = drawn.select(F.concat_ws("#", key, "i").alias(key), label, *mixed, F.lit(True).alias("synthetic"))
    return base.withColumn("synthetic", F.lit(False)).unionByName(synthetic)
