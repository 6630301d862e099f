"""factloom: relation analytics on Spark - cells, supervision, ranking, text and record hygiene as DataFrame operators."""

__version__ = "0.1.0"
