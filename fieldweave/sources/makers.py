"""SRC16: which maker's equipment a log comes from, by its column names and its path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.sources import schema

# For each maker the column names that tell it, those that hint at it, path parts and extensions;
# the weight of each; the score that is certain enough.  Of equal scores the maker listed first is taken, and a
# mark listed twice counts twice.
MAKERS: list[tuple[str, list[str], list[str], list[str], list[str]]] = [
    ("john_deere", ["vryieldvol", "vryieldmass", "yld_vol_dr", "yld_mass_d", "jd_machine", "machine_model", "operation_operator"],
     ["client", "farm", "field", "task", "product", "variety", "crop", "machine", "operator", "recording_status"],
     ["rcd", "setup", "documentation", "gs3_2630", "gs2_2600", "operations_center", "myjohndeere"], ["gsd", "fdd", "jdf"]),
    ("ag_leader", ["obj_id", "obj__id", "swth_wdth_", "yld_vol_dr", "yld_mass_w", "prod_ac_h", "duration_s", "track_deg_"],
     ["distance_f", "elevation_", "time", "crop_flow_v"], ["sms", "agleader", "agdata"], ["agdata", "ilf"]),
    ("raven", ["vipertarget", "viper_rate", "raven_rate", "prod_rate", "boom_section", "target_rate_1", "applied_rate_1"],
     ["section", "product", "tank_mix", "swath", "coverage"], ["viper", "raven", "slingshot", "vt_files", "cn1"], ["cn1", "vpr"]),
    ("trimble", ["agdata_id", "tgt_rate_o", "trimble_rate", "fmx_rate"], ["coverage", "applied", "material", "swath", "vehicle"],
     ["aggps", "agdata", "fmx", "gfx", "tmx", "trimble", "farmworks"], ["agdata", "vrt"]),
    ("case_ih", ["afs_rate", "afs_field", "voyager_id"], ["grower", "farm", "field", "load", "operator", "task"],
     ["afs", "case", "voyager", "cnh", "advanced_farming", "case_ih", "cnh_industrial", "afs_pro", "afs_connect"], ["vy1", "vy2", "vy3"]),
    ("new_holland", ["plm_rate", "nh_field", "intelliview_id"], ["grower", "farm", "field", "load", "operator", "task"],
     ["plm", "newholland", "new_holland", "intelliview", "precision_land_management"], ["vy1", "vy2", "vy3"]),
    ("bourgault", ["bourgault_rate", "x35_rate", "tank_1_rate", "tank_2_rate"], ["tank", "product", "section", "blockage", "shank"], ["bourgault", "x35", "x30", "apollo"], []),
    ("vaderstad", ["vaderstad_rate", "e_control_rate", "econtrol_id"], ["seed_rate", "fertilizer_rate", "section", "row"],
     ["vaderstad", "vaderstad", "e_control", "econtrol", "iseed", "e_services", "vaderstad_ab"], []),
    ("augmenta", ["augmenta_id", "session_id", "vigor", "vra_rate", "canopy", "crop_coverage", "biomass_index"],
     ["ndvi", "ndre", "index", "applied_rate", "machine_id", "nozzle"], ["augmenta", "augmenta_export", "field_analysis"], ["augmenta"]),
    ("climate_fieldview", ["fieldview_id", "cfv_rate"], ["hybrid", "variety", "seed_rate", "yield", "elevation"], ["fieldview", "climate"], []),
    ("topcon", ["topcon_rate", "mueller_rate"], ["task", "product", "section", "rate"], ["topcon", "mueller", "muller", "x35_topcon", "tap"], []),
    ("isoxml", ["ddi", "tlg", "grd", "pdt", "ctp"], [], ["taskdata", "taskdata.xml", "grd", "tlg"], ["iso", "xml"]),
]
COLUMN_WEIGHT, HINT_WEIGHT, PATH_WEIGHT, EXTENSION_WEIGHT = 3.0, 0.5, 2.5, 2.0
CERTAIN = 5.0


def detect_maker(columns: DataFrame, ds: str = "ds") -> DataFrame:
    """SRC16: (ds, maker, confidence) from (ds, column), ds being the path.

    A maker's score sums the weights of its marks; confidence is its share of all scores, times min(1, score / 5).
    A log without any mark is ``generic`` with confidence 0.
    """
    rows = []
    for at, (maker, *lists) in enumerate(MAKERS):
        for kind, weight, marks in zip(("column", "column", "path", "path"), (COLUMN_WEIGHT, HINT_WEIGHT, PATH_WEIGHT, EXTENSION_WEIGHT), lists):
            rows += [(at, maker, kind, m, weight) for m in marks]
    sig = columns.sparkSession.createDataFrame(rows, "at int, maker string, kind string, mark string, weight double")  # a fixed list
    sig = sig.withColumn("mark", schema.normal_name(F.col("mark")))
    logs = columns.select(ds).distinct()
    cols = columns.select(ds, schema.normal_name(F.col("column")).alias("mark")).distinct().join(F.broadcast(sig.where("kind = 'column'")), "mark").select(ds, "at", "maker", "weight")
    # one row a log against the fixed list
    path = logs.withColumn("_path", schema.normal_name(F.col(ds).cast("string"))).join(F.broadcast(sig.where("kind = 'path'")), F.contains(F.col("_path"), F.col("mark"))).select(ds, "at", "maker", "weight")
    s = cols.unionByName(path).groupBy(ds, "at", "maker").agg(F.sum("weight").alias("score"))
    w = Window.partitionBy(ds)
    s = s.withColumns({"share": F.col("score") / F.sum("score").over(w), "_k": F.row_number().over(w.orderBy(F.desc("score"), "at"))})
    best = s.where("_k = 1").select(ds, "maker", (F.col("share") * F.least(F.lit(1.0), F.col("score") / CERTAIN)).alias("confidence"))
    return logs.join(best, ds, "left").select(ds, F.coalesce("maker", F.lit("generic")).alias("maker"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
