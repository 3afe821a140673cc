"""The filter language: syntax tree, parser, builders and compiler."""
