"""Operators that turn a raw corpus into training data.

Every operator takes DataFrames and returns a DataFrame.  Nothing outside this
package imports it.
"""
