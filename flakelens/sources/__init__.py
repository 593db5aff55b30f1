"""Readers of manifests, trees and reports; writers of results."""
