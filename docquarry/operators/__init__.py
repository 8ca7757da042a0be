"""Query operators over collections of JSON documents."""
