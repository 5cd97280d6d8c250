"""verbaloom: document segmentation, translation memory and text QA on Spark DataFrames."""

__version__ = "0.1.0"
