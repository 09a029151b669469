"""Article credibility on Spark: ingest, prepare, train, evaluate, score and report on DataFrames and streams."""

from credence.operators.models import CredibilityModel, explode_explanations as explain, score
from credence.operators.normalize import normalize_articles, normalize_claims
from credence.plans.registry import load_latest, metrics_document, model_info, publish
from credence.plans.report import recent
from credence.plans.train import select_best, train
from credence.session import get_spark
from credence.sources.topic import ingest

__all__ = ["CredibilityModel", "explain", "get_spark", "ingest", "load_latest", "metrics_document", "model_info",
           "normalize_articles", "normalize_claims", "publish", "recent", "score", "select_best", "train"]
