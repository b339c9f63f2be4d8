"""Search of image stacks for faint moving objects, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
