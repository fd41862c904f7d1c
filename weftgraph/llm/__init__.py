"""Training-data operators: ten distributed operators over document tables.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers its
queries only where it can be imported.
"""
