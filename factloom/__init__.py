"""factloom: literature mining as Spark DataFrame jobs.

Articles go in as XML or JSON; statements of interaction come out as rows of
(subject, filler, object) beside the dictionary names each sentence mentions.
"""
