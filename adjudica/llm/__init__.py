"""Training-data operators: independent DataFrame-to-DataFrame components.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only when it is present.
"""
