"""Training-data operators: ten corpus-scale steps for language-model data.

Nothing outside this subpackage imports it.  ``mnemora.llm.queries`` holds the
driver-facing queries, each a thin wrapper over one operator module.
"""
