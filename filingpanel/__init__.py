"""filingpanel: disclosure-text and event-study panels on PySpark.

Every operator takes and returns DataFrames.  The data-sized work (joins,
windows, aggregation, training passes) runs in Spark; only model-sized results
(coefficients, solver input, encoder weights) reach the driver.
"""
