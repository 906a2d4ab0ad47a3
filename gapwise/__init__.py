"""gapwise: usage segmentation and service-gap recommendations on Spark.

Every public operator takes DataFrames and returns a lazy DataFrame.  The only
eager points are the ones that have to be: fitting a model, numbering ids, and
writing tables (see :mod:`gapwise.plans`).
"""
