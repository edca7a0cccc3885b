"""The flagship plan: rank the zones now.

raw events -> feature rows -> density clustering -> centroids -> nearest
centroid per row -> zone metadata -> live score over the window before
``as_of``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from hotzone import params as P
from hotzone.operators import aggregates as AG
from hotzone.operators import features as FT
from hotzone.operators import scoring as SC
from hotzone.operators import spatial as SP
from hotzone.session import saved
from hotzone.sources.events import violations_raw

AS_OF = dt.datetime(2024, 1, 31)


def preprocess(raw: DataFrame, device_threshold: int = P.FIXED_CAMERA_MIN_ROWS, sample: int | None = None,
               eps_m: float = P.DBSCAN_EPS_M, min_samples: int = P.DBSCAN_MIN_SAMPLES,
               max_m: float = P.ASSIGN_MAX_M) -> DataFrame:
    """Feature rows with ``cluster`` and ``dist_centroid_m``.

    ``sample`` clusters a deterministic sample first, as the original does with
    60,000 rows (its ``min_samples`` is tuned to that density); None clusters
    all rows. Every row is then assigned to its nearest centroid.
    """
    feats = saved(FT.build_features(raw, device_threshold=device_threshold), "features")
    pts = feats.select("id", "latitude", "longitude")
    if sample is not None:
        pts = SP.sample_n(pts, sample)
    cents = SP.centroids(SP.dbscan(pts, eps_m, min_samples))
    return SP.assign_nearest(feats, cents, max_m)


def rank_zones_now(spark: SparkSession, sf_dir: str, as_of=AS_OF, window: str = "30 days") -> DataFrame:
    features = saved(preprocess(violations_raw(spark, sf_dir), device_threshold=60), "zoned")
    meta = SC.zone_meta(AG.zone_stats(features))
    scores = SC.score_live(features, as_of, window, meta=meta)
    return scores.orderBy("congestion_score", ascending=False)
