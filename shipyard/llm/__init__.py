"""Training-data operators: each module holds one operator of general use.

``queries`` binds them to the shared tables; nothing else in the library imports
this package.
"""
