"""formflow: DataFrame operators for order forms that arrive by e-mail.

Sub-packages
------------
functions   Column -> Column expressions (text clean-up, rectangle arithmetic)
operators   DataFrame -> DataFrame transformations
sources     readers and writers
streaming   Structured Streaming jobs
plans       the registered queries and their SQL counterparts
llm         optional operators for training text; nothing else imports it
"""
