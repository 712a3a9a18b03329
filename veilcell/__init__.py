"""Private synthetic tables on Spark DataFrames."""

from .config import ClusterSpec, DerivedCluster, Interval, SynthConfig
from .plans.synthesis import Synthesizer, synthesize, synthesize_for_target
from .sources.tables import read_csv, read_csv_inferred, write_csv

__all__ = ["ClusterSpec", "DerivedCluster", "Interval", "SynthConfig", "Synthesizer", "read_csv",
           "read_csv_inferred", "synthesize", "synthesize_for_target", "write_csv"]
