"""Report tables from statistics, and the files made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower limits of the bands, in per cent.
BANDS = (("excellent", 95.0), ("good", 85.0), ("fair", 70.0))


def display_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(name, F.lit("Attack"), F.lit("")), "([A-Z])", " $1"))


def overall_mean(stats: DataFrame) -> DataFrame:
    """Mean of the attacks' means; 0 without any."""
    return stats.agg(F.coalesce(F.avg("accuracy_mean"), F.lit(0.0)).alias("overall"))


def band(value: Column) -> Column:
    out = F.lit("poor")
    for name, least in reversed(BANDS):
        out = F.when(value >= least, name).otherwise(out)
    return out


def accuracy_bands(stats: DataFrame) -> DataFrame:
    return stats.where("accuracy_mean is not null").groupBy(band(F.col("accuracy_mean")).alias("band")).agg(F.count("*").alias("n"))


def report_rows(stats: DataFrame) -> DataFrame:
    return stats.select("attack", display_name(F.col("attack")).alias("name"), F.format_string("%.2f", "accuracy_mean").alias("accuracy"), band(F.col("accuracy_mean")).alias("band")).orderBy("attack")


#: Scores of a record of results, where a run has them.
SCORES = ("accuracy", "accuracy_cross_model", "snr", "stoi", "pesq")


def nested_results(results: DataFrame) -> DataFrame:
    """clip_id and JSON of attack -> scores, attacks in order of name; scores that are null are left out."""
    item = F.struct(F.col("attack").alias("key"), F.struct(*(s for s in SCORES if s in results.columns)).alias("value"))
    return results.groupBy("clip_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(item)))).alias("scores"))


def latex(stats: DataFrame) -> str:
    """The report as a LaTeX document; stats has a row for each attack."""
    rows, mean = report_rows(stats).collect(), overall_mean(stats).first()[0]
    counts = {r["band"]: r["n"] for r in accuracy_bands(stats).collect()}
    safe = lambda s: s.replace("\\", "").replace("_", r"\_").replace("&", r"\&").replace("%", r"\%")
    table = "\n".join(rf"{safe(r['name'])} & {r['accuracy']} \\" for r in rows)
    summary = "\n".join(rf"\item {name}: {counts.get(name, 0)}" for name in (*[b for b, _ in BANDS], "poor"))
    return "\n".join(
        [r"\documentclass{article}", r"\begin{document}", r"\begin{tabular}{lr}", r"Attack & Accuracy (\%) \\", r"\hline", table, r"\end{tabular}", rf"Mean accuracy: {mean:.2f}\,\%", r"\begin{itemize}", summary, r"\end{itemize}", r"\end{document}", ""]
    )


def chart(stats: DataFrame, path: str) -> bool:
    """A bar chart as PNG, where matplotlib is installed; whether it was drawn."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return False
    rows = report_rows(stats).collect()
    figure, axes = pyplot.subplots(figsize=(max(6, len(rows) * 0.5), 5))
    axes.bar([r["name"] for r in rows], [float(r["accuracy"]) for r in rows])
    axes.set_ylim(0, 105)
    axes.set_ylabel("accuracy (%)")
    axes.tick_params(axis="x", rotation=90)
    figure.tight_layout()
    figure.savefig(path)
    pyplot.close(figure)
    return True
