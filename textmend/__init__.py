"""Noisy scanned text, repaired with DataFrame transformations.

Subpackages: ``functions`` (pure Column builders), ``operators`` (DataFrame to
DataFrame transforms), ``sources`` (readers and sinks), ``plans`` (whole
documents), ``streaming`` (the same transforms over micro-batches).
"""
