"""Analytics over large collections of tagged documents and notes, written as Spark plans."""
