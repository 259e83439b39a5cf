"""Readers of office packages, bytes to block rows: word processing, spreadsheets, presentations."""

from kunits.sources.markup import Block
from kunits.sources.sheets import cells_of, letters_number, number_letters, read_xlsx
from kunits.sources.slides import read_pptx
from kunits.sources.word import read_docx

__all__ = ["Block", "cells_of", "letters_number", "number_letters", "read_docx", "read_pptx", "read_xlsx"]
