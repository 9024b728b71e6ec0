"""Durable work on Structured Streaming: queues and batches."""

import inspect
import sys

from pyspark import cloudpickle


def by_value(*things) -> None:
    """Makes functions and classes travel with their code, not with the name of their module.

    The workers that plan streaming sources and check state schemas on the driver get
    none of the application's files, so they can't import what it consists of.
    """
    for thing in things:
        module = inspect.getmodule(thing if inspect.isroutine(thing) or inspect.isclass(thing) else type(thing))
        if module is not None and module.__name__ in sys.modules and module.__name__ != "__main__":
            cloudpickle.register_pickle_by_value(module)
