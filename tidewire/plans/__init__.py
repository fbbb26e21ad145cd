"""Logical building blocks: schemas, streams, filter trees and their parsers."""
