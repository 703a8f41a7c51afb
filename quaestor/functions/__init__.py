from quaestor.functions import parsing, text  # noqa: F401
