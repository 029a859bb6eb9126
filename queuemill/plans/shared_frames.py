"""Frames that several query modules start from."""

from queuemill.operators import sampling
from queuemill.plans import views as V


def split(spark, sf):
    return sampling.stratified_split(V.vectors(spark, sf), "category", "vec_id")
