"""Review analytics expressed as Spark DataFrame operators.

Every operator is a plain ``DataFrame -> DataFrame`` function (or a
``Column -> Column`` function in :mod:`reviewloom.functions`) that works on a
table of reviews for many products at once.
"""
