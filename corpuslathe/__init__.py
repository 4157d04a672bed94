"""A Spark engine that turns source trees and text corpora into training data."""
