"""tablegauge: how hard is a labelled table to classify, answered on Spark.

Functions take and return DataFrames.  ``by`` arguments name group columns
(for example ``["bag_id"]``); an empty ``by`` means the whole table.
"""
